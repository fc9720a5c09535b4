"""Dataset requests from batch files."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusplan.functions.text import nonempty

_ENTRY = "map<string,string>"
_NAMED = ("dataset_id", "language_pair", "category", "target_dir")


def _last_of_each(entry):
    """A map without doubled keys; the last value counts."""
    names = F.array_distinct(F.map_keys(entry))
    pairs = F.map_entries(entry)
    return F.map_from_arrays(names, F.transform(
        names, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


def one_value(text: Column) -> Column:
    """Whether a text is one JSON value and nothing more, which Spark's own functions don't mind.

    As the first of two members of an object it lets the second be found, whose name it cannot know.
    """
    mark = F.md5(text)
    inside = F.concat(F.lit('{"v":'), text, F.lit(',"'), mark, F.lit('":0}'))
    return F.coalesce(F.json_object_keys(inside) == F.array(F.lit("v"), mark), F.lit(False))


def parse_batches(texts: DataFrame, text: str = "value") -> DataFrame:
    """Add `entries` (array of maps) and `problem` to rows holding one batch each.

    A batch is a JSON array of entries or an object with `datasets`. Entries stay
    maps, so a key that is absent differs from one that is null or empty.
    """
    body = F.col(text)
    whole = one_value(body)
    is_list = whole & F.json_array_length(body).isNotNull()
    is_object = whole & F.coalesce(F.array_contains(F.json_object_keys(body), "datasets"), F.lit(False))
    entries = F.when(is_list, F.from_json(body, f"array<{_ENTRY}>")).when(
        is_object, F.from_json(body, f"struct<datasets:array<{_ENTRY}>>")["datasets"])
    listed = F.when(is_list, body).otherwise(F.get_json_object(body, "$.datasets"))
    nameless = F.exists("entries", lambda e: F.coalesce(e["dataset_id"], F.lit("")) == "")
    problem = (
        F.when(~is_list & ~is_object, "not a JSON array and not an object with 'datasets'")
        .when(F.col("entries").isNull() & (F.json_array_length(listed) > 0), "an entry is not an object")
        .when(F.coalesce(F.size("entries"), F.lit(0)) <= 0, "no datasets defined")
        .when(nameless, "an entry has no dataset_id")
    )
    entries = F.transform(entries, lambda e: F.when(e.isNotNull(), _last_of_each(e)))
    return texts.withColumn("entries", entries).withColumn("problem", problem)


def batch_requests(parsed: DataFrame) -> DataFrame:
    """Requests of parsed batches: req_id is the place in the batch's list, all
    other columns of the batch row are kept."""
    kept = [c for c in parsed.columns if c not in ("entries", "problem", "value")]
    entry = F.col("entry")
    return (
        parsed.where(F.col("problem").isNull())
        .select(*kept, F.posexplode("entries").alias("req_id", "entry"))
        .select(
            *kept,
            "req_id",
            entry["dataset_id"].alias("dataset_id"),
            nonempty(entry["language_pair"]).alias("language_pair"),
            nonempty(entry["category"]).alias("category"),
            entry["target_dir"].alias("target_dir"),
            F.map_contains_key(entry, "target_dir").alias("has_target_dir"),
            F.map_filter(entry, lambda k, _: ~k.isin(*_NAMED)).alias("extra"),
        )
    )


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """Requests of one batch file; raises when it is unreadable, malformed or empty.

    A folder may hold the file, but only one: the place in its list is the request's id.
    """
    parsed = parse_batches(spark.read.option("wholetext", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("file")))
    first = parsed.select("file", "problem").orderBy("file").take(2)
    if not first:
        raise ValueError(f"{path}: empty batch file")
    if len(first) > 1:
        raise ValueError(f"{path}: {parsed.count()} batch files, name one of them")
    if first[0].problem:
        raise ValueError(f"{first[0].file}: {first[0].problem}")
    return batch_requests(parsed.drop("file"))


def single_request(spark: SparkSession, dataset_id: str, target_dir: str | None = None,
                   language_pair: str | None = None, category: str | None = None) -> DataFrame:
    """A request table of one row."""
    row = (0, dataset_id, language_pair or None, category or None, target_dir, target_dir is not None, {})
    return spark.createDataFrame(
        [row],
        "req_id int, dataset_id string, language_pair string, category string, target_dir string, "
        "has_target_dir boolean, extra map<string,string>",
    )
