"""Personal information inside free text: found by a character-level BiLSTM-CRF, checked, and replaced.

The tagger (``tagger.train``) is fitted once per session on a bounded number of generated labelled texts, its weights
(some 200 kB, whatever the corpus) are broadcast, and every document is decoded whole, in overlapping windows. Each span
then passes an exact check of its kind, which moves its start to the first character of the item and drops what can't
be one. The rows are spread evenly over tasks first, since decoding costs far more than moving them.

Edge cases: null, empty and blank texts have no items; very long texts are many windows; control characters, emoji and
unknown scripts are ordinary characters; equal texts have equal items; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm import tagger
from netweave.llm.pii_spans import dni_letter
from netweave.llm.pii_words import TRAINED
from netweave.session import map_rows, shuffle_width

_AT = r"(?:\s?@\s?|\s?[(\[]\s?at\s?[)\]]\s?)"
_DOT = r"(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)"
EMAIL = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9._+%\-]*[A-Za-z0-9])?{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,}}", re.I)
PHONE = re.compile(r"(?:\+\s?)?(?:\(\d{1,5}\)|\d)(?:[  ./‐-―\-]?(?:\(\d{1,5}\)|\d))*")
IDENTITY = re.compile(r"(?<![A-Za-z])(?:(?!ID|NO|NR)[A-Z]{1,2}[ \-]?)?\d(?:[ .\-]?\d)*(?:[ .\-]?[A-Z](?![A-Za-z]))?")
TITLE = re.compile(r"(?:(?:Mr|Ms|Mrs|Mme|Mlle|Dr|Dra|Prof|Sr|Sra|Srta|St)\b\.?|(?:M|D)\.(?=\s+[^\W\d_]+[ .,]+[^\W\d_])(?!\s+[^\W\d_]+\s*$)|Herrn?\b|Frau\b|don\b|doña\b|Dña\.|г-н\b|г-жа\b|д-р\b)\s*", re.I)
#: Words that begin streets and places, by which a street without its kind is completed and a name refused.
STREET_KINDS = {w.lower().rstrip(".") for lang in ("fr", "es", "ru") for w in TRAINED["street_kinds"][lang]}
NO_NAME = STREET_KINDS | {w.lower() for words in TRAINED["things"].values() for w in words}
#: How a street of one word ends, before its number.
ONE_WORD = re.compile(r"[^\W\d_]*(?:" + "|".join(map(re.escape, TRAINED["street_kinds"]["de"])) + r"|strasse)\s+\d+\s?[a-z]?(?:-\d+)?", re.I)
#: The commonest Chinese family names.
HAN_FAMILY = set("王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许邓韩冯曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’‐‑][^\W\d_]+)*\.?")
HAN_STREET = re.compile(r"[㐀-鿿]{1,12}(?:路|街|巷|道|里|弄|胡同|村|坊)\s?\d+(?:\s?弄\s?\d+)?\s?[号號](?:\d+[楼樓室])?|[㐀-鿿]{1,12}(?:路|街|巷|道|里|弄|胡同|村|坊)\s?\d+")
LABELS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}


def _meets(pattern: re.Pattern, text: str, start: int, end: int, reach: int) -> tuple[int, int] | None:
    """The longest match near the span that shares a character with it."""
    best = None
    lo = max(0, start - reach)
    for m in pattern.finditer(text, lo, min(len(text), end + reach)):
        if m.start() < end and m.end() > start and (best is None or m.end() - m.start() > best[1] - best[0]):
            best = m.span()
    return best


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _identity(s: str) -> bool:
    """6 to 20 digits; points only between groups of three; eight digits and a letter are Spanish, where the letter checks the rest."""
    digits = "".join(c for c in s if c.isdigit())
    if not 6 <= len(digits) <= 20 or (set(re.findall(r"\D", s)) == {"."} and not re.fullmatch(r"\d{1,3}(?:\.\d{3})+(?:\.\d{2})?", s)):
        return False
    return not (len(digits) == 8 and s[0].isdigit() and s[-1].isalpha()) or s[-1] == dni_letter(digits)


def _name(text: str, start: int, end: int) -> tuple[int, int] | None:
    while start > 0 and (text[start - 1].isalpha() or text[start - 1] in "-'’‑") and text[start].isalpha() and not "㐀" <= text[start - 1] <= "鿿" and not "㐀" <= text[start] <= "鿿":
        start -= 1
    while start < end and not text[start].isalpha():
        start += 1
    while (m := TITLE.match(text, start, end)) and m.end() < end:
        start = m.end()
    words = _WORD.findall(text[start:end])
    # an initial or a family name alone: the given name before it belongs to it
    if words and (len(words) == 1 or len(words[0].rstrip(".")) == 1):
        before = re.search(r"(?:(?<=\W)|^)([^\W\d_]{2,}|[^\W\d_]\.)\s$", text[max(0, start - 30) : start])
        if before and before[1][0].isupper() and len(words) == 1 and len(before[1].rstrip(".")) == 1:
            start -= len(before[1]) + 1
            words = [before[1], *words]
    if m := re.search(r"(?:^|\W)(von|van) $", text[max(0, start - 6) : start]):
        start -= len(m[1]) + 1
    if re.fullmatch(r"[㐀-鿿]{2,4}", text[start:end]):
        return (start, end) if text[start] in HAN_FAMILY else None
    written = [w for w in words if w[0].isupper()]
    # one name is written in one script, and doesn't begin with a kind of street or place
    letters = [c for w in words for c in w if c.isalpha()]
    if len({"Ѐ" <= c <= "ӿ" for c in letters}) > 1 or (words and words[0].rstrip(".").lower() in NO_NAME):
        return None
    return (start, end) if len(written) >= 2 and any(len(w.rstrip(".")) > 1 for w in written) else None


#: Digits in groups of three, two and four are a social security number, never a telephone's.
SOCIAL = re.compile(r"\d{3}([ .\-])\d{2}\1\d{4}")


def check(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The exact item of a span the tagger found, or None if it can't be one."""
    if kind == "email":
        span = _meets(EMAIL, text, start, end, 80)
        # a name may follow without a space: the last label ends where its case rises
        glued = span and re.search(r"(?<=[a-z])(?=[A-Z][a-z]*$)", text[slice(*span)])
        return (span[0], span[0] + glued.start()) if glued else span
    if kind == "phone":
        span = _meets(PHONE, text, start, end, 24)
        return span if span and 7 <= _digits(text[slice(*span)]) <= 16 else None
    if kind == "id_number":
        span = _meets(IDENTITY, text, start, end, 24)
        return span if span and _identity(text[slice(*span)]) else None
    if kind == "name":
        return _name(text, start, end)
    han = lambda c: "㐀" <= c <= "鿿"
    if any(map(han, text[start:end])):
        # between a Chinese street and its number stands the kind of street
        span = _meets(HAN_STREET, text, start, end, 2)
        return (max(start, span[0]), span[1]) if span else None
    while start > 0 and text[start - 1].isalnum() and text[start].isalnum() and not han(text[start - 1]):
        start -= 1
    while start < end and not text[start].isalnum():
        start += 1
    kind_before = re.search(r"(?:^|[\s(,:])((?:[^\W\d_]+\.?|[Cc]/|Pº))\s?$", text[max(0, start - 16) : start])
    if kind_before and kind_before[1].lower().rstrip(".") in STREET_KINDS and not text[start].isdigit():
        start = text.rindex(kind_before[1], 0, start)
    if re.fullmatch(r"[^\W\d_]+\.?\s\d+\W*\w?\W*", text[start:end]) and not ONE_WORD.match(text, start, end):
        return None
    return (start, end) if any(c.isdigit() for c in text[start:end]) and any(c.isalpha() for c in text[start:end]) else None


def items(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The checked spans of one text, in order, none overlapping another."""
    found = {(*span, "id_number" if kind == "phone" and SOCIAL.fullmatch(text[slice(*span)]) else kind) for s, e, kind in spans if (span := check(text, s, e, kind))}
    out: list[tuple[int, int, str]] = []
    for item in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or item[0] >= out[-1][1]:
            out.append(item)
    return out


@lru_cache(maxsize=2)
def fitted(texts: int = tagger.TEXTS, epochs: int = tagger.EPOCHS, seed: int = 7) -> tagger.Model:
    """The tagger, fitted once per session."""
    return tagger.train(texts, epochs, seed)


def find(documents: DataFrame, model: tagger.Model | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text and items, an array of (kind, start_at, end_at), of every document with a text."""
    spark = documents.sparkSession
    weights = spark.sparkContext.broadcast((model or fitted()).p)

    def run(ids: list, texts: list) -> Iterator[tuple]:
        once = list(dict.fromkeys(texts))  # equal texts are decoded once
        tags = tagger.tag_texts(tagger.Model(weights.value), once)
        held = {t: [{"kind": k, "start_at": s, "end_at": e} for s, e, k in items(t, tagger.read_spans(g))] for t, g in zip(once, tags)}
        yield from ((i, t, held[t]) for i, t in zip(ids, texts))

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).where(F.length(F.trim("text")) > 0)
    schema = "doc_id long, text string, items array<struct<kind: string, start_at: int, end_at: int>>"
    return map_rows(rows.repartition(4 * shuffle_width(spark)), run, schema)


def found(documents: DataFrame, model: tagger.Model | None = None) -> DataFrame:
    """doc_id, kind and start_at of each item."""
    return find(documents, model).select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.kind", "i.start_at")


def _masked(text: str, spans: list) -> str:
    out, at = [], 0
    for i in spans:
        out += [text[at : i["start_at"]], LABELS[i["kind"]]]
        at = i["end_at"]
    return "".join(out) + text[at:]


def masked(documents: DataFrame, model: tagger.Model | None = None) -> DataFrame:
    """doc_id and text with a typed placeholder for each item; all other characters stay as they were."""

    def run(ids: list, texts: list, spans: list) -> Iterator[tuple]:
        yield from zip(ids, map(_masked, texts, spans))

    rest = documents.where(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0).select("doc_id", "text")
    return map_rows(find(documents, model), run, "doc_id long, text string").unionByName(rest)
