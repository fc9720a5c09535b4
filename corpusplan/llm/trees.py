"""Reading fitted trees as nested splits and as paths."""

import re

_LINE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$|^( *)Predict: (\S+)$")


def nested(debug: str):
    """A tree's printed form as (feature, threshold, low branch, high branch) or a prediction."""
    lines = [m for line in debug.splitlines() if (m := _LINE.match(line))]

    def node(at: int):
        m = lines[at]
        if m.group(7) is not None:
            return float(m.group(7)), at + 1
        low, at = node(at + 1)
        high, at = node(at + 1)  # after the line of the other branch
        return (int(m.group(3)), float(m.group(5)), low, high), at

    return node(0)[0]


def paths(tree) -> list[tuple[tuple[int, bool, float], ...]]:
    """Each node's conditions from the root: (feature, above, threshold)."""
    found = []

    def walk(node, above):
        if above:
            found.append(above)
        if isinstance(node, tuple):
            feature, threshold, low, high = node
            walk(low, above + ((feature, False, threshold),))
            walk(high, above + ((feature, True, threshold),))

    walk(tree, ())
    return found


def decide(tree, values) -> float:
    while isinstance(tree, tuple):
        feature, threshold, low, high = tree
        tree = low if values[feature] <= threshold else high
    return tree
