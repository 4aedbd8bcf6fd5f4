"""Files that were not written by hand in their repository: vendored, generated, minified and data files.

Vendored code is found by Merkle hashes, computed bottom-up: blocks of a file, the file over its blocks, directories
over their children. A hash that occurs in unrelated repositories, or in a package of the reference table, marks
outside code: a whole subtree, a whole file, or, for patched copies, most of a file's blocks. Every file, block and directory is
hashed, however small; how much a shared one shows is a matter of its weight, since two hands write a short block alike
by chance. Combining children by sums of mixed hashes, and families by least and greatest hash, keeps every level
algebraic and numeric, so a directory or block that a third of all files share is no group in one task, only a partial
sum per map task.

Generated, minified and data files follow from a file's header and layout alone, in the same scan that makes the blocks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import written

#: A text of n characters weighs n^2 / (n + SHORT): long ones nearly n, short ones next to nothing.
SHORT = 60
#: Share of a file's weight that must come from outside, and the least weight for a verdict: of the outside blocks of a file,
#: and of a file, or a directory's files, as one hash.
OUTSIDE_SHARE = 0.4
EVIDENCE = 75
WHOLE = 112
#: The family of the package table.
PACKAGES = 0
KINDS = ("data", "generated", "minified")

COMMENT = re.compile(r"\s*(?:#!(?P<bang>[^\n]*)\n|(?:(?://|#)[^\n]*(?:\n|$))|/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?'''|<!--.*?-->)", re.S)
# How tools mark what they wrote, in the six languages. A sentence on what the code itself generates
# ("ids are generated by the server") is no mark: it has another subject.
MARKS = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated (?:file|code|by|using|from|with)\b|\bautomatically generated (?:by|from|using|with)\b"
    r"|\bthis (?:file|code|module|class) (?:is|was|has been) (?:\w+ )?(?:generated|produced|created) (?:by|from|using|with)\b"
    r"|^\W*(?:code|file) (?:auto)?generated (?:by|from|using|with)\b|^\W*generated (?:by|from|using|with) \S+|\bmachine output of\b|\bmachine.generated\b"
    r"|^\W*(?:produced|created|written|emitted) by \S+ v?\d[\w.]*\b.*|\b(?:edits|changes) (?:get|will be|are) (?:overwritten|lost)\b|\bregenerate instead\b"
    r"|\bwurde (?:automatisch )?(?:von|durch|mit) \S+(?: \S+)? (?:erzeugt|generiert|erstellt)\b|\bautomatisch (?:erzeugt|generiert)\b"
    r"|\b(?:produit|généré|créé) automatiquement\b|\bautomatiquement (?:produit|généré)\b|\bgenerad[oa] (?:automáticamente|por)\b|\barchivo generado\b"
    r"|\bgerad[oa] (?:automaticamente|por)\b|\barquivo gerado\b|自动生成|由\s*\S+\s*生成",
    re.IGNORECASE | re.MULTILINE,
)
BUNDLED_NAME = re.compile(r"[.\-_](min|bundle|packed|prod)\.[mc]?js$", re.IGNORECASE)
QUOTED = re.compile(
    r"(?P<doc>\"\"\".*?\"\"\"|'''.*?'''|/\*.*?\*/|//[^\n]*|^\s*#[^\n]*)|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)",
    re.S | re.M,
)
NUMBERS = re.compile(r"\b(?:0x[0-9a-fA-F]+|\d[\d.eE_]*)\b")
INK = re.compile(r"[^\s,]+")
CODE_LINE = re.compile(r"[{}()]|=>|==|;\s*$")
RUNNING = re.compile(r"(?<=[A-Za-z_])(\d{2,})\b")


def family(repo: str | None) -> str:
    """Repositories are related if they share the part of the name before the first - or /; those without a name are."""
    return re.split(r"[-/]", repo or "", maxsplit=1)[0] or "?"


def header(text: str) -> str:
    """The comments that a file opens with."""
    out, at = [], 0
    while m := COMMENT.match(text, at):
        if m.end() == at:
            break
        out.append(m[0])
        at = m.end()
    return "".join(out)


def bare(text: str) -> str:
    """The text without its opening comments."""
    at = 0
    while m := COMMENT.match(text, at):
        if m.end() == at:
            break
        at = m.end()
    return text[at:]


def squeeze(block: str) -> str:
    return "\n".join(" ".join(line.split()) for line in block.split("\n") if line.strip())


def blocks(text: str) -> list[str]:
    """Top-level blocks of a text without its header: separated by empty lines, white space made even."""
    body = bare(text.replace("\r\n", "\n").replace("\r", "\n"))
    return [s for s in (squeeze(b) for b in re.split(r"\n[ \t]*\n", body)) if s]


def key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def is_markup(text: str) -> bool:
    return bool(re.match(r"\s*(<!doctype|<\?xml|<html|<[a-z]+[ >])", text, re.IGNORECASE))


def is_minified(text: str, path: str) -> bool:
    """Script text in few, long lines with hardly any white space and many marks, which is neither one string nor numbers."""
    lines = [x for x in bare(text).split("\n") if x.strip()]
    if not lines:
        return False
    chars = sum(map(len, lines))
    blank = sum(x.count(" ") + x.count("\t") for x in lines) / chars
    marks = sum(x.count(c) for x in lines for c in "{}();=,") / chars
    average = chars / len(lines)
    named = bool(BUNDLED_NAME.search(path))
    return chars >= 200 and blank < 0.12 and marks > 0.12 and (average > 120 or (named and average > 60))


def literal_share(text: str) -> tuple[float, float, int]:
    """(share of literals, share of numbers and long unbroken strings, characters) of a text without comments and white space."""
    literal = bulk = total = at = 0
    bare_parts = []
    for m in QUOTED.finditer(text):
        bare_parts.append(text[at : m.start()])
        at = m.end()
        if m.lastgroup == "str":
            n = m.end() - m.start()
            literal += n
            total += n
            if n > 120 and not re.search(r"\s", m[0]):
                bulk += n
    bare_parts.append(text[at:])
    rest = "\n".join(bare_parts)
    total += sum(map(len, INK.findall(rest)))
    numbers = sum(map(len, NUMBERS.findall(rest)))
    literal, bulk = literal + numbers, bulk + numbers
    return (literal / total, bulk / total, total) if total else (0.0, 0.0, 0)


def is_table(text: str) -> bool:
    """Comma, semicolon or tab separated values: nearly all of at least five lines have the same number of them, hardly one is code."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 5:
        return False
    code, most_code = 0, 0.05 * len(lines)
    for x in lines:
        if CODE_LINE.search(x):
            code += 1
            if code > most_code:
                return False
    for sep in ",;\t|":
        n = Counter(x.count(sep) for x in lines)
        most, often = n.most_common(1)[0]
        if most >= 1 and often >= 0.9 * len(lines) and not any(x.rstrip().endswith(sep) for x in lines[1:-1]):
            return True
    return False


def is_json(text: str) -> bool:
    t = text.strip()
    if t[:1] not in ("{", "["):
        return False
    try:
        return isinstance(json.loads(t), (dict, list))
    except (ValueError, RecursionError):
        return False


def is_data(text: str) -> bool:
    share, bulk, total = literal_share(bare(text))
    return (total >= 120 and (bulk >= 0.75 or share >= 0.92)) or is_table(text) or is_json(text)


def is_stamped_out(text: str) -> bool:
    """A layout that no hand writes: most blocks repeat a few shapes, and their running numbers count up."""
    own = blocks(text)
    found = [RUNNING.search(b.split("\n", 1)[0]) for b in own]
    numbers = [int(m[1]) for m in found if m]
    if len(numbers) < 5:
        return False
    rising = sum(1 for a, b in zip(numbers, numbers[1:]) if b in (a, a + 1))
    few = sum(n for _, n in Counter(re.sub(r"\w+", "w", b) for b, m in zip(own, found) if m).most_common(4))
    return few >= 0.6 * len(own) and rising >= 0.8 * (len(numbers) - 1)


def lines_stamped_out(text: str) -> bool:
    """The same for members without empty lines between them: names with a running number over most declaring lines."""
    numbers = [int(n) for n in re.findall(r"\b[A-Za-z_]+?(\d{2,})\s*(?:\(|=\s*function)", text)]
    distinct = sorted(set(numbers))
    lines = sum(1 for x in text.split("\n") if x.strip())
    return len(distinct) >= 6 and distinct[-1] - distinct[0] == len(distinct) - 1 and distinct[0] <= 1 and len(numbers) * 8 >= lines


def kind_by_layout(path: str, text: str) -> str | None:
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    if is_markup(t):
        return None
    if MARKS.search(header(t)):
        return "generated"
    if is_data(t):
        return "data"
    if re.search(r"\.[mc]?[jt]sx?$", path, re.IGNORECASE) and is_minified(t, path):
        return "minified"
    if is_stamped_out(t) or lines_stamped_out(t):
        return "generated"
    return None


def mixed(name: str) -> int:
    return key(name) or 1


def leaves(files: DataFrame, packages: bool = False, related: Callable[[str | None], str] = family) -> DataFrame:
    """(file_id, repo, family, path, judged, kind, chars, file_key, blocks array<struct<k, n>>) of files with text; one scan.

    family is the hash of what ``related`` makes of the repository's name, PACKAGES for packages; kind an index of KINDS.
    .json files and markup are hashed like all others, but carry no weight and are not judged.
    """
    schema = "file_id bigint, repo string, family bigint, path string, judged boolean, kind int, chars int, file_key bigint, blocks array<struct<k:bigint,n:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, str], tuple] = {}  # copies that meet in a task are read once
        families: dict[str | None, int] = {}
        for pdf in batches:
            rows = []
            for i, repo, path, text in zip(pdf["file_id"], pdf["repo"], pdf["path"], pdf["text"]):
                path = path or ""
                end = path.lower().rpartition(".")[2] + ("!" if BUNDLED_NAME.search(path) else "")
                at = (hash(text), len(text), end)
                got = seen.get(at)
                if got is None:
                    b = blocks(text)
                    whole = "\n".join(b)
                    plain = end == "json" or is_markup(text)
                    kind = None if packages or plain else kind_by_layout(path, text)
                    own = [] if plain else [{"k": key(x), "n": len(x)} for x in set(b)]
                    got = (end != "json", None if kind is None else KINDS.index(kind), 0 if plain else len(whole), key(whole), own)
                    if len(seen) > 20_000:
                        seen.clear()
                    seen[at] = got
                if repo not in families:
                    families[repo] = PACKAGES if packages else mixed(related(repo))
                rows.append((i, repo, families[repo], path, *got))
            yield pd.DataFrame(rows, columns=["file_id", "repo", "family", "path", "judged", "kind", "chars", "file_key", "blocks"]).astype({"kind": "Int32"})

    return files.where("text is not null and file_id is not null").select("file_id", "repo", "path", "text").mapInPandas(run, schema)


def weight(n: Column) -> Column:
    return n.cast("double") * n / (n + F.lit(SHORT))


def outside(keys: DataFrame) -> DataFrame:
    """(k) of the hashes that packages hold or that unrelated repositories share; ``keys`` has (k, family).

    The least and greatest family are enough, so the counts of a hash shared by a third of all files combine map-side.
    """
    g = keys.groupBy("k").agg(F.min("family").alias("a"), F.max("family").alias("b"))
    return g.where(f"a <> b or a = {PACKAGES}").select("k")


def subtrees(files: DataFrame) -> DataFrame:
    """(repo, dir, k, family, n, weight): the Merkle hash of every directory over the hashes of its files and directories.

    A directory's hash mixes the sum of its children's mixed hashes with their number: order-free and algebraic. Levels
    are made from the deepest up, however deep, each written once and read by the level above it. Repeated rows of a
    file count once. ``files`` has (repo, path, file_key, chars) and, where it isn't the repository itself, family.
    """
    at = F.regexp_replace("path", r"/?[^/]*$", "")
    of = F.col("family") if "family" in files.columns else F.xxhash64("repo")
    one = files.select("repo", "path", of.alias("family"), F.col("file_key").alias("k"), weight(F.col("chars")).alias("weight")).distinct()
    level = written(one.select("repo", at.alias("dir"), "family", "k", "weight", F.when(at == "", 0).otherwise(F.size(F.split(at, "/"))).alias("depth")), "files")
    deepest = level.agg(F.max("depth")).first()[0] or 0
    done: list[DataFrame] = []
    above: DataFrame | None = None
    for d in range(deepest, 0, -1):
        here = level.where(F.col("depth") == d).select("repo", "dir", "family", "k", "weight", F.lit(1).cast("bigint").alias("n"))
        if above is not None:
            here = here.unionByName(above)
        hashed = F.xxhash64(F.sum(F.xxhash64("k").bitwiseAND(F.lit((1 << 40) - 1))), F.count(F.lit(1)))
        g = written(here.groupBy("repo", "dir").agg(hashed.alias("k"), F.min("family").alias("family"), F.sum("weight").alias("weight"), F.sum("n").alias("n")), "tree")
        done.append(g)
        above = g.select("repo", F.regexp_replace("dir", r"/?[^/]*$", "").alias("dir"), "family", "k", "weight", "n")
    out = done[0] if done else level.select("repo", "dir", "k", "family", "weight", F.lit(0).cast("bigint").alias("n")).limit(0)
    for g in done[1:]:
        out = out.unionByName(g)
    return out


def foreign(files: DataFrame, third_party: DataFrame, related: Callable[[str | None], str] = family) -> DataFrame:
    """(file_id, kind) of every file that wasn't written by hand: kind is generated, minified, data or vendored.

    Repeated rows of a file are one file; null and empty texts, .json files and markup are no case. ``files`` has
    (file_id, repo, file_path, text), ``third_party`` (item_id, package, file_name, text); either may be empty.
    ``related`` names the family of a repository: code that only its family shares is its own.
    """
    own = files.select("file_id", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("file_path", F.lit("")).alias("path"), "text")
    mine = written(leaves(own, related=related), "leaves")
    refs = written(leaves(third_party.select(F.col("item_id").alias("file_id"), F.col("package").alias("repo"), F.col("file_name").alias("path"), "text"), packages=True), "packages")
    both = mine.unionByName(refs)

    weighty = weight(F.col("chars")) >= WHOLE
    shared_files = outside(both.where(weighty).select(F.col("file_key").alias("k"), "family"))
    whole = mine.where(weighty).select("file_id", F.col("file_key").alias("k")).join(shared_files, "k", "left_semi").select("file_id")

    spread = both.select("file_id", "family", F.posexplode("blocks").alias("at", "b")).select("file_id", "family", "at", F.col("b.k").alias("k"), weight(F.col("b.n")).alias("w"))
    from_outside = outside(spread.select("k", "family")).withColumn("out", F.lit(1))
    mass = (
        spread.where(f"family <> {PACKAGES}").join(from_outside, "k", "left").groupBy("file_id")
        .agg(F.sum("w").alias("all"), F.sum(F.when(F.col("out") == 1, F.col("w")).otherwise(0)).alias("foreign"), F.count_if(F.col("at") == 0).alias("copies"))
    )
    patched = mass.where((F.col("foreign") >= F.col("all") * OUTSIDE_SHARE) & (F.col("foreign") >= F.col("copies") * EVIDENCE)).select("file_id")

    trees = written(subtrees(mine).where((F.col("n") >= 2) & (F.col("weight") >= WHOLE)), "trees")
    shared_dirs = trees.join(outside(trees.select("k", "family")), "k", "left_semi").select("repo", "dir")
    above = mine.select("file_id", "repo", F.explode(F.expr("transform(sequence(1, greatest(1, size(split(path, '/')) - 1)), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("dir"))
    under = above.join(shared_dirs, ["repo", "dir"], "left_semi").select("file_id")

    vendored = whole.unionByName(patched).unionByName(under).select("file_id", F.lit(len(KINDS)).alias("kind"))
    # a file of text without a case may lie in a shared directory: empty ones and markup stay out
    judged = mine.where("judged and (chars > 0 or kind is not null)").select("file_id", "kind", F.lit(True).alias("judged"))
    least = judged.unionByName(vendored.withColumn("judged", F.lit(False))).groupBy("file_id").agg(F.min("kind").alias("kind"), F.max("judged").alias("judged"))
    names = F.array(*(F.lit(k) for k in (*KINDS, "vendored")))
    return least.where("judged and kind is not null").select("file_id", F.get(names, F.col("kind")).alias("kind"))


def handwritten(files: DataFrame, third_party: DataFrame, summaries: DataFrame) -> DataFrame:
    """(repo, n_files, n_foreign, n_handwritten, indexed_files): what remains per repository, beside its last index pass.

    indexed_files is the file count of the pass of the greatest (indexed_at, pass_id) that has one, null without any.
    """
    found = foreign(files, third_party)
    one = files.where("file_id is not null").groupBy("file_id").agg(F.min("repo").alias("repo"))
    per = one.join(found, "file_id", "left").groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), F.count("kind").alias("n_foreign"))
    last = summaries.where("files is not null").groupBy("repo").agg(F.max_by("files", F.struct("indexed_at", "pass_id")).alias("indexed_files"))
    return per.join(last, "repo", "left").select("repo", "n_files", "n_foreign", (F.col("n_files") - F.col("n_foreign")).alias("n_handwritten"), "indexed_files")
