"""Broken prompt and response pairs: empty, truncated, refusing, copying and wrong-language responses.

Two statistical stages and a rule stage:

* language: posteriors of prompt and response from a character n-gram naive Bayes (``language``); a response is
  defective if its language is clearly not the prompt's, or not the one that the prompt asks for;
* truncation: the likelihood that a text ends where it ends. For the last characters of a text that has no closing
  mark, the longest n-gram that other responses hold often enough, down to the last character alone, says how often a
  sentence ends after it; a last letter that no other response holds ends none. The grams of all responses are counted, in
  two steps: a bitmap sized by the asked keys keeps the grams that can matter, then exact 64-bit keys are counted with
  map-side partial sums;
* empty texts, refusals and copies follow from the text, or text and prompt, alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import language
from weftgraph.session import written

WORKED, WRONG = ("worked", "ok", "good"), ("wrong", "bad", "failed")
ORDERS = (1, 2, 3, 4, 6, 8, 11, 14)
#: How often other responses must hold a gram for it to count; a single last character, the last resort, always does.
LEAST_SEEN = 4
#: Share of sentence ends after the gram under which a text is truncated.
ENDS_RARELY = 0.05
#: Bits of the filter of grams: eight for each asked key, within these bounds (2^27 bits are 16 MB).
LEAST_BITS, MOST_BITS = 20, 27
#: Nats by which another language must win.
LANGUAGE_MARGIN = 4.0

# Words that stand for no answer, in the six languages.
PLACEHOLDERS = frozenset(
    "null none nil n/a na n.a. tbd tba todo fixme xxx empty blank missing placeholder undefined nan no answer "
    "unknown ninguno nenhum nada keine leer aucun vide vazio vacío 无 暂无 空 待定".split()
) | {"no answer", "not available", "to do", "to be done", "to be determined", "no response", "sin respuesta", "sem resposta", "keine antwort", "pas de réponse"}
# How the six languages decline to answer; only the speaker's own inability or unwillingness counts.
_SAY = r"(?:help|assist|answer|discuss|provide|talk|say|comment|respond|share|tell|explain|support)"
REFUSALS = re.compile(
    "|".join(
        (
            rf"\bI(?:'m| am|'ve| have)?\b[^.,;:!?\n]{{0,30}}(?:can(?:'t|not| not)|unable to|not able to|won't(?: be)?|will not(?: be)?|would rather not|(?:must|have to) decline to|not (?:allowed|permitted|in a position) to|refuse to|(?:do not|don't) (?:want|wish) to)\s+(?:\w+\s+)?{_SAY}(?:ing|s)?\b",
            rf"\b(?:not|isn't) something I (?:can|may|could|am able to|would)\b[^.\n]{{0,20}}{_SAY}",
            r"\b(?:keep|keeps|prevent|prevents|stop|stops|bar|bars|forbid|forbids) me (?:from|to) (?:answer|discuss|help|respond|assist)",
            r"\boutside (?:of )?what I(?:'m| am) (?:allowed|permitted)",
            r"\bno comment\b",
            r"\b(?:not|n't) be appropriate for me\b",
            r"\bI have been told to leave\b",
            r"^\W*request (?:denied|refused|declined)\b\s*[:.!]",
            r"\bagainst my (?:guidelines|policy|instructions)\b",
            r"\bno (?:me )?(?:puedo|podemos|está permitido|me está permitido)\s+(?:ayudar|responder|contestar|hablar|asist)",
            r"\bno me está permitido\b|\bno tengo permi(?:so|tido)\b",
            r"\bnão (?:posso|podemos|consigo)\s+(?:te |lhe |vos )?(?:ajudar|responder|falar|comentar|auxiliar)",
            r"\bnão tenho permissão\b|\bnão me é permitido\b",
            r"\b(?:dabei|damit|hierbei) kann ich (?:\w+ )?nicht (?:helfen|dienen)|\bkann ich (?:leider )?(?:\w+ )?nicht (?:helfen|beantworten)|\bich kann (?:\w+ ){0,3}nicht (?:helfen|beantworten)",
            r"\bdarf ich (?:leider )?(?:\w+ )?nicht (?:beantworten|sagen|besprechen)|\bich darf (?:\w+ ){0,3}nicht (?:beantworten|sagen|besprechen)",
            r"\bje ne peux (?:malheureusement )?pas (?:vous |t'|te )?(?:aider|répondre|en parler|commenter)",
            r"\bje ne suis pas (?:autorisée?|en mesure|habilitée?)\b",
            r"(?:无法|不能|不便|不可以|没法)(?:帮助?你|回答|协助|提供帮助|讨论|透露|为你)",
            r"我(?:没有权限|不被允许|无权)",
        )
    ),
    re.IGNORECASE,
)
# Names of the languages in the six languages, in the order of language.LANGUAGES.
NAMES = {
    "de": ("german", "alemán", "alemão", "deutsch", "allemand", "德语", "德文"),
    "en": ("english", "inglés", "inglês", "englisch", "anglais", "英语", "英文"),
    "es": ("spanish", "español", "espanhol", "spanisch", "espagnol", "西班牙语", "castellano"),
    "fr": ("french", "francés", "francês", "französisch", "français", "法语", "法文"),
    "pt": ("portuguese", "portugués", "português", "portugiesisch", "portugais", "葡萄牙语"),
    "zh": ("chinese", "chino", "chinês", "chinesisch", "chinois", "中文", "汉语"),
}
_NAME = {n: k for k, names in NAMES.items() for n in names}
ASKED = re.compile(
    r"(?:\b(?:answer|reply|respond|write|explain|responde|responda|responder|contesta|conteste|antworte|antworten sie|schreib|réponds|répondez|écris|in|en|em|auf)\b[^.?!。？\n]{0,30}?\b(?:in|en|em|auf|på)?\s*|用)(" + "|".join(_NAME) + r")",
    re.IGNORECASE,
)
QUOTES = re.compile(r"```.*?(?:```|$)|`[^`\n]*`|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|\"[^\"\n]*\"|「[^」\n]*」|^>.*$", re.S | re.M)
NAMES_IN_CODE = re.compile(r"\b\w*(?:[a-z][A-Z]|_)\w*\b|\S*[/\\]\S+|\b\w+\.\w{1,4}\b|\d+")
CLOSED = re.compile(r"[.!?。！？…][\"”»’')\]）」]*$")
INVISIBLE = dict.fromkeys(c for c in range(0x2000, 0x2100) if unicodedata.category(chr(c)) == "Cf") | {0xFEFF: None, 0xAD: None}


def visible(text: str | None) -> str:
    return (text or "").translate(INVISIBLE).replace("\xa0", " ").strip()


def is_empty(text: str | None) -> bool:
    t = visible(text)
    core = t.strip("()[]<>{}*_~\"'.!?:;-–— \t\r\n").lower()
    return not any(c.isalnum() for c in t) or t.lower() in PLACEHOLDERS or core in PLACEHOLDERS


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+|[^\W]", text.casefold().replace("_", "\x00"), re.UNICODE)


def is_copy(question: str | None, answer: str) -> bool:
    """Whether nothing is left of the answer without the question, but a label that ends in a colon before it."""
    squash = lambda s: "".join(c for c in unicodedata.normalize("NFKC", s).casefold() if c.isalnum())
    q = squash(question or "")
    if len(q) < 4:
        return False
    label, colon, rest = re.split(r"([:：])", answer, maxsplit=1) if re.match(r"[^\n:：]{1,40}[:：]", answer) else ("", "", answer)
    for part in (answer, rest):
        a = squash(part)
        if a and not a.replace(q, ""):
            return True
    return False


def breaks_off(text: str) -> bool:
    """What the shape alone shows: an open code fence, bracket, quote or code span at the end, an item without text."""
    t = text.rstrip()
    if len(re.findall(r"^[ \t]*```", t, re.M)) % 2:
        return True
    last = t.rsplit("\n", 1)[-1]
    if re.fullmatch(r"\s*(?:\d{1,3}[.)]|[-*+•])", last):
        return "\n" in t
    plain = re.sub(r"```.*?```", "", t, flags=re.S).rsplit("\n", 1)[-1]
    return plain.count("`") % 2 == 1 or plain.rstrip()[-1:] in "([{（,，:：;“„«" and bool(plain.strip()) or plain.count("“") > plain.count("”")


def needs_likelihood(text: str) -> bool:
    """Whether how it ends is a question of likelihood: words stand in its last line, and no closing mark."""
    t = text.rstrip()
    if not t or CLOSED.search(t) or t.endswith("```") or t.endswith("`"):
        return False
    return bool(re.search(r"[^\W\d_]{2}", re.sub(r"`[^`]*`", "", t)))


def end_grams(text: str) -> list[tuple[int, int]]:
    """(order, key) of the text's last characters."""
    t = text.rstrip()
    codes = np.array([ord(c) for c in t[-max(ORDERS) :]], np.uint64)
    return [(n, int(_keys(codes[len(codes) - n :], n)[0])) for n in ORDERS if len(codes) >= n]


def _keys(codes: np.ndarray, n: int) -> np.ndarray:
    """63-bit keys of all n-grams."""
    h = np.full(max(0, len(codes) - n + 1), n, np.uint64)
    for k in range(n):
        h = (h ^ codes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(1)).astype(np.int64)


def count_grams(texts: list[str], wanted: np.ndarray) -> pd.DataFrame:
    """(key, seen, ended) of the grams in ``texts`` whose bit is set in ``wanted``, a filter of 2^k bits.

    A gram that a text ends with, without a closing mark, is neither: whether it may end there is what is asked.
    """
    texts = [t.rstrip() for t in texts if t and t.strip()]
    if not texts:
        return pd.DataFrame({"key": [], "seen": [], "ended": []}).astype("int64")
    joined = "\0".join(texts) + "\0\0\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mark = np.isin(codes, [ord(c) for c in ".!?"])
    full = np.isin(codes, [ord(c) for c in "。！？\n"])
    gap = np.isin(codes, [ord(c) for c in " \n\"”»)\0"])
    ends = full | (mark & np.concatenate([gap[1:], [True]]))
    stop = codes == 0
    out = []
    for n in ORDERS:
        keys = _keys(codes, n)[: len(codes) - n]
        after = np.arange(n, n + len(keys))
        across = np.concatenate([[0], np.cumsum(stop)])
        # the gram itself and the character after it lie in one text
        ok = (across[after + 1] - across[after - n]) == 0
        keys, after = keys[ok], after[ok]
        hit = wanted[keys & (len(wanted) - 1)]
        keys, after = keys[hit], after[hit]
        if len(keys):
            u, at = np.unique(keys, return_inverse=True)
            out.append(pd.DataFrame({"key": u, "seen": np.bincount(at), "ended": np.bincount(at, ends[after]).astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"key": [], "seen": [], "ended": []}).astype("int64")


def responses(entries: DataFrame) -> DataFrame:
    """(id, field, question, text) of each distinct entry: answer, and correction where it replaced a wrong answer.

    Repeated rows of an id count once (the row of the least received_at, then recorded); rows with a null id are left out.
    """
    first = Window.partitionBy("id").orderBy(F.col("received_at").asc_nulls_last(), F.col("recorded").asc_nulls_last())
    outcome = F.lower(F.trim(F.coalesce("outcome", F.lit(""))))
    one = (
        entries.where("id is not null").select("id", "question", "answer", "correction", "outcome", "recorded", "received_at")
        .withColumn("r", F.row_number().over(first)).where("r = 1")
    )
    field = F.array(
        F.struct(F.lit("answer").alias("field"), F.col("answer").alias("text")),
        F.when(F.col("correction").isNotNull() & outcome.isin(*WRONG), F.struct(F.lit("correction").alias("field"), F.col("correction").alias("text"))),
    )
    return one.select("id", "question", F.explode(F.filter(field, lambda f: f.isNotNull())).alias("f")).select("id", F.col("f.field").alias("field"), "question", F.col("f.text").alias("text"))


def end_likelihood(rows: DataFrame) -> DataFrame:
    """(id, field, n, seen, ended, letter) of the texts without a closing mark, by the longest of their last n-grams that is seen often enough."""
    schema = "id bigint, field string, n int, key bigint, letter boolean"

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [
                (i, f, n, k, visible(t)[-1:].isalpha())
                for i, f, t in zip(pdf["id"], pdf["field"], pdf["text"])
                if t is not None and needs_likelihood(visible(t))
                for n, k in end_grams(visible(t))
            ]
            yield pd.DataFrame(got, columns=["id", "field", "n", "key", "letter"])

    asked = written(rows.select("id", "field", "text").mapInPandas(last, schema), "ends")
    # as many 64-bit words as the filter has, at most, come to the driver and go out again
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (8 * asked.count()).bit_length()))
    bit = F.col("key").bitwiseAND(F.lit(size - 1))
    words = asked.groupBy(F.shiftright(bit, 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("b")).toArrow()
    wanted = np.zeros(size // 64, np.int64)
    wanted[words.column("w").to_numpy()] = words.column("b").to_numpy()
    filter_bits = rows.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(filter_bits.value.astype("<i8").view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            texts = [visible(t) for t in batch.column(0).to_pylist() if t]
            for a in range(0, len(texts), 4000):
                got = count_grams(texts[a : a + 4000], bitmap)
                yield pa.RecordBatch.from_pandas(got, preserve_index=False)

    seen = rows.select("text").mapInArrow(count, "key bigint, seen bigint, ended bigint").groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    enough = asked.join(seen, "key").where((F.col("seen") >= LEAST_SEEN) | (F.col("n") == 1))
    best = enough.groupBy("id", "field").agg(F.max_by(F.struct("seen", "ended"), "n").alias("b"), F.max("n").alias("n"))
    unseen = asked.groupBy("id", "field").agg(F.max("letter").alias("letter"))
    return unseen.join(best, ["id", "field"], "left").select("id", "field", F.col("n"), F.col("b.seen").alias("seen"), F.col("b.ended").alias("ended"), "letter")


def stripped(text: str) -> str:
    """The words of a text that show its language: without code, quotations, names, paths and numbers."""
    return " ".join(NAMES_IN_CODE.sub(" ", QUOTES.sub(" ", text)).split())


def target_language(question: str) -> str | None:
    m = ASKED.search(question)
    return _NAME.get(m[1].lower()) if m else None


def learned(rows: DataFrame) -> DataFrame:
    """(question, text): the words of all pairs that the language model also learns from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"question": [stripped(q) for q in pdf["question"]], "text": [stripped(visible(t)) for t in pdf["text"]]})

    return rows.where("question is not null and text is not null").select("question", "text").mapInPandas(run, "question string, text string")


def _kind(question: str | None, text: str | None, ends_rarely: bool) -> str | None:
    if is_empty(text):
        return "empty"
    t = visible(text)
    if is_copy(question, t):
        return "copy"
    if REFUSALS.search(QUOTES.sub(" ", t)):
        return "refusal"
    if breaks_off(t) or ends_rarely:
        return "truncated"
    return None


def defects(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, field, defect) of each defective response.

    Null and blank texts and placeholders are empty; a null question rules out copy and language. Repeats of an entry
    count once. An empty table gives no rows; without labelled documents no language is told apart.
    """
    rows = written(responses(entries), "responses")
    model = rows.sparkSession.sparkContext.broadcast(language.train(documents, learned(rows)).table)
    ends = end_likelihood(rows)
    # a last letter that stands nowhere else ends no known sentence; of any other last character nothing is known
    rare = ends.where(F.coalesce(F.col("ended") < F.col("seen") * ENDS_RARELY, "letter")).select("id", "field", F.lit(True).alias("rare"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nb = language.NaiveBayes(model.value)
        for pdf in batches:
            out, open_rows = [], []
            for i, f, q, t, r in zip(pdf["id"], pdf["field"], pdf["question"], pdf["text"], pdf["rare"]):
                kind = _kind(q, t, r)
                if kind:
                    out.append((i, f, kind))
                elif q:
                    open_rows.append((i, f, stripped(q), stripped(visible(t)), target_language(q)))
            if open_rows:
                mine, theirs = nb.scores([r[3] for r in open_rows]), nb.scores([r[2] for r in open_rows])
                for (i, f, _, text, asked), a, q in zip(open_rows, mine, theirs):
                    if asked:
                        lost = a.max() - a[language.LANGUAGES.index(asked)]
                    else:  # both in their best languages against both in one
                        lost = a.max() + q.max() - (a + q).max()
                    letters = sum(2 if ord(c) > 0x2E7F else 1 for c in text if c.isalpha())
                    if letters >= 8 and lost > LANGUAGE_MARGIN:
                        out.append((i, f, "language"))
            yield pd.DataFrame(out, columns=["id", "field", "defect"])

    return rows.join(rare, ["id", "field"], "left").withColumn("rare", F.coalesce("rare", F.lit(False))).mapInPandas(run, "id bigint, field string, defect string")
