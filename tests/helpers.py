REQUEST = (
    "req_id int, dataset_id string, language_pair string, category string, target_dir string, "
    "has_target_dir boolean, extra map<string,string>"
)
ANCHOR = "page_url string, pos int, href string"


def requests(spark, *rows):
    """Rows of (dataset_id, {other fields}); req_id is the place."""
    full = [
        (i, dataset, f.get("language_pair"), f.get("category"), f.get("target_dir"), "target_dir" in f,
         {k: v for k, v in f.items() if k not in ("language_pair", "category", "target_dir")})
        for i, (dataset, f) in enumerate(rows)
    ]
    return spark.createDataFrame(full, REQUEST)


def anchors(spark, pages):
    """{page: [href, ...]} in document order."""
    rows = [(page, i, href) for page, hrefs in pages.items() for i, href in enumerate(hrefs)]
    return spark.createDataFrame(rows, ANCHOR)


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
