"""Personal data: base patterns, plus terms that reveal a protected entity by corpus co-occurrence.

Base spans (email, ip, card, phone) are found by pattern and checks, leftmost and non-overlapping
per kind.  Each distinct value is a protected entity.  For the information-theoretic part, every
term (words, A-Z lower-cased, without punctuation at their ends, that touch no span) of a document
that mentions an entity is scored, however rare the entity is:

    bits(e; t) = IC(e) - PMI(e; t) = -log2 P(e | t)

the information about e that somebody who reads t still lacks: with 4 bits left, e is one of about 16 equally
likely entities.  n(e, t) and n(t) count documents, over all of them and as wholes; those that mention e and are near copies of
each other (classes of ``jaccard_join``) count once.  P(e | t) is not n(e, t) / n(t) itself but the lower end
of its one-sided 95 % interval (Wilson, with continuity correction), so chance is priced in by how
little was seen: one document of one leaves 3.8 bits, two of two 2.0, five of five 0.9, one of two 4.8.  A term
that leaves at most ``GENERALISE`` bits is generalised, one that leaves at most ``REMOVE`` is removed, in every document that
mentions e.  So one sighting can generalise a term but never removes it, and the bars do not depend on
how many other documents there are.  Documents without base spans are never touched, and base spans always stay.
``redact`` writes a generalised term as its kind (name, number, code or word).

Scale: one pass finds entities, and terms as hashes (64 bits; a document that mentions an entity is known by 64 bits of its id and text); entities that the same documents mention have
the same counts and are scored as one group; pairs are aggregated with partial sums on (group, term,
class), a frequent key is split by its count; document frequencies are counted only for words in a bitmap
sized by their number (256 MB at most, broadcast; a chance hit only counts a word more); only texts with base spans
are written and read again.

Cases: a null text is empty and has no spans.  A null id is a document of its own kind: its base
spans are reported, its mentions are not evidence and it gets no added spans.  n counts rows; rows
that repeat an id are documents of their own.  Other columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import bitmap_bits, bitmap_holds, enter, hash_bitmap, spread_join, stage_table
from tenderlake.llm.jaccard_join import linked_classes
from tenderlake.llm.textarrays import chunks, split_words

Z = 1.645                        # one-sided 95 %
GENERALISE = 4.0                 # bits
REMOVE = 1.0
KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The spans of the literal pattern, found from each @ outwards (no scan a start)."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            last = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` in code points, by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(d := p.lstrip("0")) < 3 or (len(d) == 3 and d <= "255") for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def entity(kind: str, value: str) -> str:
    return f"{kind}:{_NOT_DIGIT.sub('', value) if kind in ('card', 'phone') else value.translate(_LOWER)}"


def term(word: str) -> str:
    return word.strip(_ENDS).translate(_LOWER)


def free_words(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int]], list[bool]]:
    """Start and end of every word, and whether it touches no span."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    inside: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):          # spans that overlap as one
        if inside and a <= inside[-1][1]:
            inside[-1][1] = max(inside[-1][1], b)
        else:
            inside.append([a, b])
    free, k = [], 0
    for a, b in words:
        while k < len(inside) and inside[k][1] <= a:
            k += 1
        free.append(k == len(inside) or inside[k][0] >= b)
    return words, free


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The distinct terms of a whole document."""
    return sorted({term(text[a:b]) for (a, b), f in zip(*free_words(text, spans)) if f} - {""})


def join_spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FOUND = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, entities array<string>, terms array<bigint>, body string"


def term_hashes(terms: list[str]) -> list[int]:
    return split_words(pa.array(terms, pa.string()), lower=True, trim=True).hash.astype(np.int64).tolist() if terms else []


def find_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and base spans of every document; of those with spans the entities, hashes of terms, and the text.

    ``row`` is a hash of id and body.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pii")
        for batch in batches:
            for part in chunks(batch, text_col):
                counts, joined, who, held, body = [], [], [], [], []
                for text in part.column(text_col).to_pylist():
                    spans = base_spans(text) if text else []
                    counts.append([sum(k == s[0] for s in spans) for k in KINDS])
                    joined.append(join_spans(spans))
                    who.append(sorted({entity(k, text[a:b]) for k, a, b in spans}))
                    held.append(sorted(set(term_hashes(free_terms(text, spans)))) if spans else [])
                    body.append(text if spans else None)
                cols = list(zip(*counts)) if counts else [[]] * 4
                yield pa.record_batch([part.column(id_col), *[pa.array(c, pa.int64()) for c in cols], pa.array(joined, pa.string()),
                                       pa.array(who, pa.list_(pa.string())), pa.array(held, pa.list_(pa.int64())), pa.array(body, pa.string())],
                                      names=[id_col, *[f"n_{k}" for k in KINDS], "base", "entities", "terms", "body"])

    found = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {_FOUND}")
    return found.withColumn("row", F.xxhash64(F.col(id_col), F.col("body")))


def _document_frequency(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``h, n_term``: documents that hold each wanted word, over the whole table."""
    bits = bitmap_bits(wanted.count())
    shared = docs.sparkSession.sparkContext.broadcast((hash_bitmap(wanted, "h", bits), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pii")
        held: list[np.ndarray] = []

        def counts() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["h", "n"])

        for batch in batches:
            for part in chunks(batch, text_col):
                words = split_words(part.column(text_col), lower=True, trim=True)
                at = np.flatnonzero(bitmap_holds(shared.value[0], words.hash, shared.value[1]))
                doc = np.searchsorted(words.first, at, "right") - 1
                h = words.hash[at].astype(np.int64)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                held.append(h[np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))] if len(h) else h)
                if sum(map(len, held)) > 4_000_000:
                    yield counts()
        yield counts()

    rows = docs.filter(F.col(id_col).isNotNull()).select(text_col).mapInArrow(run, "h bigint, n bigint")
    return rows.groupBy("h").agg(F.sum("n").alias("n_term")).join(wanted, "h", "left_semi")


def _known(found: DataFrame, id_col: str) -> DataFrame:
    return found.filter(F.col(id_col).isNotNull() & (F.size("entities") > 0))


def mentioned(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``row, who, n_rows, unit``: what each document mentions; ``who`` is a group of entities with the same documents,
    ``n_rows`` their number, and documents that are near copies have the same ``unit``."""
    known = _known(found, id_col)
    mention = known.select("row", F.explode("entities").alias("entity"))
    some = F.lit(1 << 31)
    sums = [F.sum(F.pmod(h, some)).alias(n) for n, h in (("_a", F.col("row")), ("_b", F.xxhash64("row")))]
    groups = (mention.groupBy("entity").agg(F.count("*").alias("n_rows"), *sums)
              .select("entity", F.xxhash64("n_rows", "_a", "_b").alias("who"), "n_rows"))
    held = stage_table(spread_join(mention, stage_table(groups, "pii-entities"), "entity", F.col("row"))
                       .select("row", "who", "n_rows").distinct(), "pii-mentions")
    shared = held.filter("n_rows > 1").select("row").distinct()
    bodies = stage_table(known.select("row", "body").join(shared, "row", "left_semi").dropDuplicates(["row"]), "pii-shared")
    if bodies.isEmpty():
        return held.withColumn("unit", F.col("row"))
    classes = linked_classes(bodies, "row", "body").groupBy("row").agg(F.min("component_id").alias("_class"))
    return stage_table(held.join(classes, "row", "left").withColumn("unit", F.coalesce("_class", "row")).drop("_class"), "pii-units")


def lower_bound(k: Column, n: Column) -> Column:
    """Lower end of the one-sided interval of a share seen as k of n (k > 0): Wilson with continuity correction."""
    z2, p = Z * Z, k / n
    return (2 * k + z2 - 1 - Z * F.sqrt(z2 - 2 - 1 / n + 4 * p * (n - k + 1))) / (2 * (n + z2))


def disclosing_terms(docs: DataFrame, found: DataFrame, held: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     generalise: float = GENERALISE) -> DataFrame:
    """``who, h, bits``: terms that leave at most ``generalise`` bits about the entities."""
    rows = _known(found, id_col).select("row", "terms").join(held, "row")
    pairs = (rows.select("who", "unit", F.explode("terms").alias("h")).groupBy("who", "h", "unit").agg(F.count("*").alias("_n"))
             .groupBy("who", "h").agg(F.sum("_n").alias("n_both_rows"), F.count("*").alias("n_both")))
    pairs = stage_table(pairs, "pii-pairs")
    words = stage_table(pairs.select("h").distinct(), "pii-words")
    df = stage_table(_document_frequency(docs, words, id_col, text_col), "pii-frequencies")
    scored = spread_join(pairs, df, "h", F.col("who"), counted=pairs)
    n_term = F.col("n_term") - F.col("n_both_rows") + F.col("n_both")
    bits = -F.log2(lower_bound(F.col("n_both").cast("double"), n_term.cast("double")))
    return scored.select("who", "h", bits.alias("bits")).filter(F.col("bits") <= generalise)


def added_spans(found: DataFrame, held: DataFrame, terms: DataFrame, id_col: str = "doc_id", remove: float = REMOVE) -> DataFrame:
    """``row, added``: spans ``remove`` / ``generalise`` of disclosing terms in documents that mention the entity."""
    known = _known(found, id_col)
    pair = F.xxhash64("who", "h").alias("pair")
    every = known.select("row", "terms").join(held.select("row", "who"), "row").select("row", "who", F.explode("terms").alias("h")).select("row", "h", pair)
    marked = (spread_join(every, terms.select(pair, "bits"), "pair", F.col("row")).groupBy("row", "h").agg(F.min("bits").alias("bits"))
              .groupBy("row").agg(F.collect_list(F.struct("h", "bits")).alias("_terms")))
    texts = known.select("row", "base", "body").dropDuplicates(["row"]).join(marked, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pii")
        for batch in batches:
            out = []
            for text, base, terms_ in zip(*[batch.column(c).to_pylist() for c in ("body", "base", "_terms")]):
                left = {t["h"]: t["bits"] for t in terms_}
                words, free = free_words(text, [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(","))])
                at = [(a, b, t) for (a, b), f in zip(words, free) if f and (t := term(text[a:b]))]
                spans = []
                for (a, b, t), h in zip(at, term_hashes([t for _, _, t in at])):
                    if (r := left.get(h)) is not None:
                        a += len(text[a:b]) - len(text[a:b].lstrip(_ENDS))
                        spans.append(("remove" if r <= remove else "generalise", a, a + len(t)))
                out.append(join_spans(sorted(spans, key=lambda s: (s[0] != "generalise", s[1]))))
            yield pa.record_batch([batch.column("row"), pa.array(out, pa.string())], names=["row", "added"])

    return texts.mapInArrow(run, "row bigint, added string")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE,
             remove: float = REMOVE) -> DataFrame:
    """One row a document: ``id_col, n_email, n_ip, n_card, n_phone, base, spans`` (spans: base, then added)."""
    found = stage_table(find_base(docs, id_col, text_col), "pii-found")
    counts = [f"n_{k}" for k in KINDS]
    held = mentioned(found, id_col)
    terms = stage_table(disclosing_terms(docs, found, held, id_col, text_col, generalise), "pii-terms")
    extra = added_spans(found, held, terms, id_col, remove).withColumnRenamed("row", "_xrow")
    known = F.col(id_col).isNotNull() & (F.col("row") == F.col("_xrow"))
    spans = F.concat_ws(",", F.nullif(F.col("base"), F.lit("")), F.nullif(F.col("added"), F.lit("")))
    return (found.select(id_col, *counts, "base", "row").join(extra, known, "left")
            .select(id_col, *counts, "base", spans.alias("spans")))


def general_form(term_: str) -> str:
    """The kind that a generalised term is written as."""
    if all(c.isdigit() or c in ".,:/-" for c in term_):
        return "[NUMBER]"
    if any(c.isdigit() for c in term_):
        return "[CODE]"
    return "[NAME]" if term_[:1].isupper() else "[WORD]"


def redact(text: str, spans: str) -> str:
    """The text with base spans replaced by their kind, generalised terms by their general form, removed ones by nothing."""
    out, at = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= at:
            out += [text[at:a], "" if kind == "remove" else general_form(text[a:b]) if kind == "generalise" else f"[{kind.upper()}]"]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]
