"""Scalar functions on text, paths and endpoints, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_EDGE = r"(?<![\p{L}\p{N}_])"


def parent_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def normalise_path(path: Column) -> Column:
    """The path without . and with .. resolved; .. above the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(kept, "/")


def join_relative(base_dir: Column, target: Column) -> Column:
    return normalise_path(F.concat_ws("/", base_dir, target))


def shared_prefix_len(a: Column, b: Column) -> Column:
    """How many leading path parts two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other == 0, F.size(same)).otherwise(first_other - 1).cast("int")


# How paths of tests and of bundled code look, in lower case.
TEST_PATH = r"(^|/)tests/|test_|_test\.|\.test\.|\.spec\."
VENDORED_PATH = r"\.min\.|(^|/)(vendor|vendored|third_party|thirdparty)(/|$)"


def is_test_file(path: Column) -> Column:
    """Whether a path looks like a test's: a folder named tests, or test_, _test., .test. or .spec. anywhere in it."""
    return F.lower(path).rlike(TEST_PATH)


def is_vendored(path: Column) -> Column:
    """Whether a path is a bundle of others: a minified file, or a part of the path that says so."""
    return F.lower(path).rlike(VENDORED_PATH)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def endpoint_shape(name: Column, trim_slash: bool = True) -> Column:
    """'GET /a/{id}' with every parameter part, {x}, :x, <x>, $x, * or digits, as *; the trailing slash goes unless told."""
    method, path = F.upper(F.regexp_extract(name, r"^(\S+)\s+", 1)), F.regexp_replace(name, r"^\S+\s+", "")
    if trim_slash:
        path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    part = lambda p: F.when(p.rlike(r"^(\{.*\}|:.+|<.*>|\$.+|\*|\d+)$"), F.lit("*")).otherwise(p)
    return F.concat_ws(" ", method, F.array_join(F.transform(F.split(path, "/"), part), "/"))


def mention_tokens(text: Column) -> Column:
    """Distinct tokens of a text: runs of letters, digits and _, longer than two bytes."""
    return F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda t: F.octet_length(t) > 2))


def whole_word_count(text: Column, word: Column) -> Column:
    """How often the word stands in the text with no letter, digit or _ on either side."""
    pattern = F.concat(F.lit(WORD_EDGE + r"\Q"), word, F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.regexp_count(text, pattern)


def whole_word_replace(text: Column, word: Column, new: Column) -> Column:
    pattern = F.concat(F.lit(WORD_EDGE + r"\Q"), word, F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.regexp_replace(text, pattern, F.regexp_replace(new, r"([\\$])", r"\\$1"))


def collapse(text: Column, most: int = 40_000) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def strip_cues(text: Column) -> Column:
    """A transcript without its numbering, time codes and header."""
    line = r"(?m)^(WEBVTT.*|NOTE.*|\d+|\d{1,2}:\d{2}(:\d{2})?[.,]\d{3}\s*-->.*)$"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, line, ""), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def strip_json_comments(text: Column) -> Column:
    """JSON without comments and trailing commas; both stay inside strings."""
    bare = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    return F.regexp_replace(bare, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")


def redact(url: Column) -> Column:
    """A connection string without its password, in URL or keyword form."""
    return F.regexp_replace(F.regexp_replace(url, r"(://[^:/?#@\s]*):[^@/\s]*@", "$1:***@"), r"(?i)\b(password\s*=\s*)('[^']*'|\S+)", "$1***")


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def script_escape(text: Column) -> Column:
    """For a single-quoted string of an import script."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def nearest_rank(values: Column, percent: int) -> Column:
    """The nearest-rank percentile of a collected array: the element at ceil(last * p / 100)."""
    ordered = F.array_sort(values)
    at = F.ceil((F.size(ordered) - 1) * F.lit(percent) / F.lit(100)).cast("int") + 1
    return F.when(F.size(ordered) > 0, F.element_at(ordered, at))
