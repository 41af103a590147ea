"""Word lists, tables and patterns that results depend on."""

from __future__ import annotations

#: Stopwords of the "lab" profile.
LAB_STOPWORDS = (
    "a an the and or but if while with without of to in on for from by as at is are was were "
    "be been being this that these those it its into about after before than then also may will would should "
    "could can has have had do does did not new said their his her they them he she we you i our your"
).split()

#: Stopwords of the "web" profile.
WEB_STOPWORDS = (
    "a an the and or but if while with without of to in on for from by as at is are was were be been being "
    "this that these those it its into about after before than then also may will would should could can has have had "
    "do does did not said their his her they them he she we you i our your there which who whom what when where"
).split()

#: Suffix rules of the stemmer, tried in this order: suffix -> replacement.
SUFFIX_RULES = {
    "ization": "ize",
    "ational": "ate",
    "fulness": "ful",
    "ousness": "ous",
    "iveness": "ive",
    "tional": "tion",
    "ments": "ment",
    "ingly": "",
    "edly": "",
    "ing": "",
    "ied": "y",
    "ies": "y",
    "ed": "",
    "ly": "",
    "es": "",
    "s": "",
}

#: Irregular base forms of the "lab" lemmatizer.
LAB_LEMMAS = {
    "children": "child", "men": "man", "women": "woman", "people": "person", "mice": "mouse", "geese": "goose",
    "feet": "foot", "teeth": "tooth", "better": "good", "best": "good", "worse": "bad", "won": "win", "winning": "win",
    "ran": "run", "running": "run", "companies": "company", "policies": "policy", "prices": "price",
    "services": "service", "families": "family", "technologies": "technology", "queries": "query", "documents": "document",
}

#: The "web" lemmatizer knows four more.
WEB_LEMMAS = LAB_LEMMAS | {"matches": "match", "players": "player", "leaders": "leader", "reports": "report"}

#: Query expansion.
SYNONYMS = {
    "ai": ["artificial", "intelligence"],
    "govt": ["government"],
    "econ": ["economic", "economy"],
    "tech": ["technology", "technological"],
    "pm": ["prime", "minister"],
    "cup": ["tournament", "championship"],
    "movie": ["film"],
    "film": ["movie"],
    "job": ["employment"],
    "match": ["game", "fixture"],
}

#: Evaluation queries and the category each is meant for.
EVALUATION_SEEDS = [
    ("stock market economic growth", "business"),
    ("company profits investment", "business"),
    ("government policy reform", "politics"),
    ("prime minister election", "politics"),
    ("football team tournament match", "sport"),
    ("player championship victory", "sport"),
    ("artificial intelligence technology", "tech"),
    ("software cloud computing data", "tech"),
    ("film actor award", "entertainment"),
    ("music concert celebrity", "entertainment"),
]

LAB_TOKEN = "[A-Za-z0-9_]+"
LAB_HYPHENATED_TOKEN = "[A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)*"
WEB_TOKEN = "[a-z0-9]+"
TAG = "<[^>]+>"
URL = r"http\S+|www\.\S+"
SENTENCE_END = "[.!?]+"
VOWELS = "[aeiouy]+"
ABSOLUTE_LINK = r"""(?i)href=["'](https?://[^"'#]+)"""
ANY_LINK = r"""(?i)href=["']([^"'#]+)"""
TITLE = "(?is)<title[^>]*>(.*?)</title>"

HOME_URL = "local-news://home"
HOME_TITLE = "Start page"
HOME_TEXT = "Every section of the collection is linked from here."
SYNDICATED_SENTENCE = " This report was later updated with additional wire-service coverage."
