"""Fixed values of the corpora served by this package.

These are facts about the published data (addresses, versions, file name forms,
category words); results are only right when they are exactly these.
"""

# Index addresses. `{version}` stands for the resolved version.
EUROPARL_INDEX = "http://statmt.org/europarl/{version}/"
NEWS_COMMENTARY_INDEX = "http://data.statmt.org/news-commentary/{version}/training/"
WMT_INDEX = "http://statmt.org/wmt{version}/"
UN_CORPUS_FILE = "http://statmt.org/wmt13/training-parallel-un-v1.0.tgz"

# Family prefixes in match order.
EUROPARL = "europarl"
NEWS_COMMENTARY = "news-commentary"
WMT = "wmt"
UN_CORPUS = "un-corpus"

# Version used when a dataset id does not end in digits.
EUROPARL_VERSION = "v7"
NEWS_COMMENTARY_VERSION = "v15"
WMT_VERSION = "14"
UN_CORPUS_VERSION = "v1.0"

# File name forms and category words.
TRAIN_MARK = "-train"
TRAIN_SUFFIX = ".tgz"
NEWS_PAIR = r"[.]([a-z]{2}-[a-z]{2})[.](?:tsv|tsv[.]gz)\z"
NEWS_STEM = "news-commentary-"
CATEGORY_WORDS = ("training", "test", "dev")
ARCHIVE_SUFFIXES = (".tgz", ".gz", ".tar.gz", ".zip")

# The catalogue of known datasets
# (id, description, language pairs, categories).
CATALOGUE = [
    ("europarl-v7", "Europarl v7 parallel corpus", ["de-en", "fr-en", "es-en", "en-fi", "en-cs"], None),
    ("news-commentary-v15", "News Commentary v15", ["de-en", "zh-en", "ru-en", "fr-en"], None),
    ("un-corpus-v1.0", "UN parallel corpus v1.0", None, None),
    ("wmt14", "WMT14 dataset", None, ["training-monolingual", "training-parallel", "test"]),
]

# Default parent directory and size of the "recent" ledger view.
DEFAULT_PARENT = "./data"
RECENT_ENTRIES = 5
