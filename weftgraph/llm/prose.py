"""What of a document is prose: its full sentences, without code, tables, lists, traces and headings."""

from __future__ import annotations

import re

FENCE = re.compile(r"^[ \t]{0,3}(```|~~~)")
#: Lines of a block that are never prose: headings, table rows, list items, quotes of traces, rules, keys, markup, statements.
OTHER = re.compile(
    r"^(?:#{1,6}\s|\||\s*(?:[-*+•–]|\(?\d{1,3}[.)])\s|[=\-~*_]{3,}\s*$|\t| {4}"
    r"|\s*at\s+\S+\s*\(|\s*File \".*\", line \d+|Traceback \(most recent|panic at\b|\s*\w*(?:Error|Exception)\b:?"
    r"|\s*[\w\"'./{}$-]+:\s*(?:$|[\[{|>'\"\d])|\s*<[/!?\w]|\s*[\]{}()]+[;,]?\s*$|.*[{;]\s*$|\s*@\w+\(?)"
)
SENTENCE_END = re.compile(r"(?<=[.!?…])[\"”»’')\]]*\s+(?=[\"“«‘'(\[¿¡`]*[\w`])")
SETEXT = re.compile(r"^(?:={3,}|-{3,})\s*$")
#: Marks that code has and sentences hardly do.
CODE_MARK = re.compile(r"[{}=;]|\)\s*:|->|::|\w\(")
WORD = re.compile(r"[^\W_]")


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text, wrapped lines joined; fenced and indented code and all other block kinds left out."""
    out: list[str] = []
    now: list[str] = []
    fence = ""
    for line in text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ").split("\n"):
        m = FENCE.match(line)
        if fence:
            if m and m[1] == fence:
                fence = ""
            continue
        if m:
            fence = m[1]
        if m or not line.strip():
            if now:
                out.append(" ".join(now))
                now = []
            continue
        if SETEXT.match(line) and len(now) == 1:
            now = []
        elif OTHER.match(line):
            if now:
                out.append(" ".join(now))
                now = []
        else:
            now.append(line.strip())
    if now:
        out.append(" ".join(now))
    return out


def sentences(text: str) -> list[str]:
    """Full sentences: they end in a full stop, question or exclamation mark, and hold at least two words and little code."""
    got: list[str] = []
    for p in paragraphs(text):
        for s in SENTENCE_END.split(p):
            s = s.strip()
            bare = s.rstrip("\"”»’')]")
            if not bare or bare[-1] not in ".!?…":
                continue
            words = s.split()
            if len(words) >= 2 and len(CODE_MARK.findall(s)) * 4 <= len(words):
                got.append(s)
    return got


def count_words(sentence: str) -> int:
    return sum(1 for w in sentence.split() if WORD.search(w))
