import collections
import hashlib
import math
import re
import uuid
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

from tenderlake.llm import improbable_digest, pii, quality_nbsvm, warc_derive
from tenderlake.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"


class _Text(HTMLParser):
    """The same rules on the standard parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.head, self.title = [], 0, False, False

    def _leave_head(self, tag):
        self.head &= tag in ("base", "basefont", "bgsound", "link", "meta", "head", "title", "script", "style", "noscript", "template")

    def handle_starttag(self, tag, attrs):
        self._leave_head(tag)
        self.head |= tag == "head"
        self.title |= tag == "title"
        self.hidden += tag in ("script", "style", "noscript", "template")
        self.out.append("\n" if tag in warc_derive.BLOCK_TAGS and not self.hidden and not self.head else "")

    def handle_endtag(self, tag):
        self._leave_head(tag)
        self.head &= tag != "head"
        self.title &= tag != "title"
        self.hidden -= tag in ("script", "style", "noscript", "template")
        self.out.append("\n" if tag in warc_derive.BLOCK_TAGS and not self.hidden and not self.head else "")

    def handle_data(self, data):
        if data.strip() and not self.hidden and not self.title:
            self.head = False
        if not self.hidden and not self.head:
            self.out.append(data.replace("\n", " "))

    def text(self, page):
        self.feed(page)
        self.close()
        return "\n".join(x for x in (" ".join(line.split()) for line in "".join(self.out).split("\n")) if x)


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>T</title><body><p>Hello visible world</p>", "Hello visible world"),
    ("<head><meta charset=x><title>T</title>\nBare text <b>here</b></head> too", "Bare text here too"),
    ("<head><title>T</title><script>s()</script><link a=b></head><header>Top</header>x", "Top\nx"),
    ("<header>Not a head</header><p>x", "Not a head\nx"), ("<head><title>open to the end <p>x", ""), ("<head><p>a</head><p>b", "a\nb")])
def test_a_head_without_its_closing_tag(page, text):
    assert warc_derive.visible_text(page) == text
    if "open to" not in page:
        assert _Text().text(page) == text


def test_op1_query(spark):
    got = LLM_QUERIES["op1_warc_derivatives"](spark, SF).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert collections.Counter((r["page_id"], r["warc_type"]) for r in got) == collections.Counter((p, t) for p in pages for t in ("metadata", "conversion"))
    for r in got:
        page = pages[r["page_id"]]
        uuid.UUID(r["record_id"][10:-1]), uuid.UUID(r["refers_to"][10:-1])
        assert r["target_uri"] == page["url"] and r["source_payload_digest"] == warc_derive.digest(page["html"].encode())
        assert r["block_digest"] == warc_derive.digest(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
        assert f"WARC-Refers-To: {r['refers_to']}\r\n" in r["header"] and r["header"].endswith("\r\n\r\n")
        if r["warc_type"] == "conversion":
            assert r["block"] == _Text().text(page["html"])
        else:
            assert f"source-payload-digest: {r['source_payload_digest']}\r\n" in r["block"]
            assert "http-header: Content-Type: text/html; charset=utf-8\r\n" in r["block"]


def test_warc_edge_cases(spark):
    rows = [(1, None, None, None, None, None, "x"), (2, "r", "http://a.example/x/y", "d", "HTTP/1.1 404 Not\r\nA: b\r\n\r\n", b"<p>a<script>b", "x"),
            (3, "r", "http://a.example/", "d", "", b"<a href='../z?q=1&amp;r#f'>1 &lt; 2</a><!-- <a href=no> <a\nHREF=b>c</a><a href=#x><br>\xff", "x"),
            (4, "r", "u", "d", None, b"<" * 5000 + b"a" * 5000, "x"), (4, "r", "u", "d", None, b"<" * 5000 + b"a" * 5000, "x")]
    frame = spark.createDataFrame(rows, "page_id int, record_id string, target_uri string, date string, http_header string, payload binary, block string")
    got = warc_derive.derive(frame, keep=("page_id",)).collect()
    assert len(got) == 10 and warc_derive.derive(frame.limit(0)).count() == 0
    text = {r["page_id"]: r["block"] for r in got if r["warc_type"] == "conversion"}
    assert text[1] == "" and text[2] == "a" and text[3] == "1 < 2"
    meta = {r["page_id"]: r["block"] for r in got if r["warc_type"] == "metadata"}
    assert "outlink: http://a.example/z?q=1&r#f\r\n" in meta[3] and meta[3].count("outlink") == 1
    assert "http-status: HTTP/1.1 404 Not\r\n" in meta[2] and "WARC-Target-URI" not in next(r["header"] for r in got if r["page_id"] == 1)
    a, b = [r for r in got if r["page_id"] == 4 and r["warc_type"] == "conversion"]
    assert a == b


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    model = quality_nbsvm.train(docs, labels, max_rows=2000)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in quality_nbsvm.score(docs, model).collect()}
    test = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    right = np.mean([got[d]["predicted"] == truth[d] for d in test])
    clean = np.mean([got[d]["predicted"] for d in test if truth[d] == 1])
    assert len(test) > 500 and right > 0.98 and clean > 0.99
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())


def test_quality_edge_cases(spark, edge, edge_rows, nothing):
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(20)] + [(None, 1, 0), (3, None, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_nbsvm.train(edge, labels)
    assert quality_nbsvm.score(edge, model).count() == len(edge_rows)
    kept = quality_nbsvm.keep_good(edge, model)
    assert kept.columns == edge.columns
    for some, want in ((labels.limit(0), 1), (labels.filter("quality = 1"), 1), (labels.filter("quality = 0"), 0)):
        one = quality_nbsvm.train(edge, some)
        assert {r["predicted"] for r in quality_nbsvm.score(edge, one).collect()} == {want}
    assert quality_nbsvm.score(nothing, model).count() == 0 and quality_nbsvm.keep_good(nothing, quality_nbsvm.train(nothing, labels)).count() == 0
    again = quality_nbsvm.train(edge.repartition(5), labels.repartition(3))
    assert (again["weight"] == model["weight"]).all() and again["bias"] == model["bias"]


def test_dual_descent_reaches_the_optimum():
    """Primal and dual value meet, on data that no line separates; the model scales r by these weights alone."""
    r = np.random.default_rng(4)
    rows = [np.unique(r.integers(0, 60, 12) + (0 if r.random() < 0.8 else 20) * (k % 3 > 0)).astype(np.uint32) for k in range(150)]
    y = np.where(np.arange(150) % 3 != 0, 1.0, -1.0)
    vec = [r.normal(size=len(x)).astype(np.float32) / 3 for x in rows]
    upper = np.where(y > 0, 0.75, 1.5)
    w, b, alpha = quality_nbsvm.dual_descent(rows, vec, y, upper, 100, 2000, 1, 1e-9)
    margin = np.array([w[x] @ v + b for x, v in zip(rows, vec)])
    primal = (w @ w + b * b) / 2 + (upper * np.maximum(0, 1 - y * margin)).sum()
    dual = alpha.sum() - (w @ w + b * b) / 2
    assert ((alpha >= 0) & (alpha <= upper)).all() and 0 < dual <= primal + 1e-6 and primal - dual < 1e-3 * primal
    assert (1 - y * margin > 1e-3).any()
    model = quality_nbsvm.fit(rows, (y > 0).astype(int), epochs=300)
    pos, neg = 1 + np.bincount(np.concatenate([x for x, v in zip(rows, y) if v > 0]), minlength=100), 1 + np.bincount(np.concatenate([x for x, v in zip(rows, y) if v < 0]), minlength=100)
    size = 1 << quality_nbsvm.BITS
    ratio = np.log((pos / (pos.sum() + size - 100)) / (neg / (neg.sum() + size - 100)))
    ratio[(pos == 1) & (neg == 1)] = 0
    assert np.allclose(model["square"][:100], ratio ** 2, rtol=1e-4)


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(s):
    return re.sub("[^0-9]", "", s)


def _luhn(d):
    return sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(reversed(d))) % 10 == 0


def _literal(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(_digits(m[0])) <= 19 and _luhn(_digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]


def test_base_spans_equal_the_literal_patterns():
    import random
    r = random.Random(7)
    bits = ["a", "b.c", "@", ".", "-", "1", "25", "300", "4111111111111111", "4111 1111-1111 1111", " ", "+1 (555) 123-4567", "+", "(", "é", "x@y.z", "..", "٣", "0"]
    for _ in range(20000):
        text = "".join(r.choices(bits, k=r.randint(0, 14)))
        assert pii.base_spans(text) == _literal(text), text


def test_pii_query_and_terms(spark, small_rows, edge, edge_rows, nothing):
    got = {r["doc_id"]: r for r in LLM_QUERIES["op8_pii"](spark, SF).collect()}
    assert len(got) == len(small_rows)
    for d, t in small_rows:
        want = _literal(t)
        r = got[d]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert r["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in want)) and (want or r["spans"] == "")
    # "zyxgroup" appears only around one address, in different contexts; "the" everywhere
    rows = [(k, f"the note {k} of zyxgroup, the list m{k} boss@corp.example.com wrote the text {k}") for k in range(6)]
    rows += [(100 + k, f"the plain text {k} has the words of a list and a note") for k in range(60)] + [(200, "zyxgroup here, boss@corp.example.com")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(frame).collect()}
    text = dict(rows)
    marked = [text[0][int(a):int(b)] for k, a, b in (s.split(":") for s in found[0].split(",")) if k in ("remove", "generalise")]
    assert "zyxgroup" in marked and "the" not in marked and all(found[100 + k] == "" for k in range(60))
    assert "zyxgroup" not in pii.redact(text[0], found[0]) and "[EMAIL]" in pii.redact(text[0], found[0])
    assert pii.redact("Zyx met x9 at 10:30 in rome", "generalise:0:3,generalise:8:10,generalise:14:19,remove:23:27") == "[NAME] met [CODE] at [NUMBER] in "
    assert pii.find_pii(edge).count() == len(edge_rows) and pii.find_pii(nothing).count() == 0


def _brute_added(rows, units):
    """The added spans of every document by the definition; ``units``: the class of each document among near copies."""
    spans = {d: _literal(t or "") for d, t in rows}
    who = {d: {pii.entity(k, t[a:b]) for k, a, b in spans[d]} for d, t in rows if spans[d]}
    terms, places = {}, {}
    for d, t in rows:
        taken = {p for _, a, b in spans[d] for p in range(a, b)}
        places[d] = []
        free = set()
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t or ""):
            word = m[0].strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum()))
            if word and taken.isdisjoint(range(*m.span())):
                a = m.start() + len(m[0]) - len(m[0].lstrip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum())))
                low = word.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                places[d].append((low, a, a + len(word)))
                free.add(low)
        # the corpus count of a term does not look at spans
        every = {m.strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum())).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                 for m in re.findall(r"[^\x20\x09-\x0D]+", t or "")}
        terms[d] = (free, every)
    out = {}
    z2 = 1.645 ** 2
    for d, t in rows:
        best = {}
        for e in who.get(d, ()):
            holders = [x for x in who if e in who[x]]
            for low in terms[d][0]:
                both = [x for x in holders if low in terms[x][0]]
                k = len({units[x] for x in both})
                n = sum(low in terms[x][1] for x, _ in rows) - len(both) + k
                p = k / n
                bound = (2 * k + z2 - 1 - 1.645 * math.sqrt(z2 - 2 - 1 / n + 4 * p * (n - k + 1))) / (2 * (n + z2))
                best[low] = min(best.get(low, 99), -math.log2(bound))
        added = [("generalise" if best[w] > pii.REMOVE else "remove", a, b) for w, a, b in places[d] if best.get(w, 99) <= pii.GENERALISE]
        out[d] = ",".join(f"{k}:{a}:{b}" for k, a, b in [*spans[d], *sorted(added, key=lambda s: (s[0] != "generalise", s[1]))])
    return out


def _private_rows():
    import random
    r = random.Random(11)
    vocabulary = [f"Term{k}" for k in range(40)] + ["the", "of", "(a)", "Straße,", "x-1", "12,5"]
    rows = []
    for d in range(120):
        words = r.choices(vocabulary, k=r.randint(3, 25)) + [f"only{d}"]
        if d % 3 == 0:
            words.insert(r.randint(0, len(words)), f"mail p{d % 4}@corp.example.com")
            words += [f"Secret{d % 4}"] * r.randint(0, 2)
        if d % 10 == 0:
            words += ["host", f"10.0.0.{d % 20}"]
        rows.append((d, " ".join(words)))
    body = " ".join(f"long{i}" for i in range(150))
    return rows + [(500 + k, f"{body} copyword copy{k} then many@corp.example.com") for k in range(6)], {d: d if d < 500 else 500 for d in [*range(120), *range(500, 506)]}


def test_added_spans_equal_brute_force_and_do_not_move_with_the_corpus(spark):
    rows, units = _private_rows()
    want = _brute_added(rows, units)
    assert any("remove" in s for s in want.values()) and any("generalise" in s for s in want.values())
    assert {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    more = rows + [(10_000 + k, f"unrelated u{k} list nothing here") for k in range(3000)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    assert {d: got[d] for d in want} == want and all(got[10_000 + k] == "" for k in range(3000))


def test_very_long_digit_runs():
    text = "1." + "0" * 5000 + ".1.1 and 1.2.3.256 and 0" + "0" * 5000 + "255.1.1.1"
    assert [text[a:b][-9:] for k, a, b in pii.base_spans(text) if k == "ip"] == ["00000.1.1", "255.1.1.1"]


def test_pii_scores_rare_entities_over_whole_documents(spark):
    """An entity mentioned once: a term far from it is scored; near copies count as one document."""
    fill = " ".join(f"plain{i}" for i in range(60))
    rows = [(k, f"{fill} number n{k} of the list") for k in range(600)]
    rows.append((1000, f"zyxgroup starts here, {fill} and ends with rare@corp.example.com only"))
    body = " ".join(f"w{i}" for i in range(150))
    rows += [(2000 + k, f"{body} copyword copy{k} then many@corp.example.com") for k in range(8)]
    rows += [(3000 + k, " ".join(f"v{k}x{i}" for i in range(40)) + " ownword then twice@corp.example.com") for k in range(8)]
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def marks(d):
        return {dict(rows)[d][int(a):int(b)]: k for k, a, b in (s.split(":") for s in found[d].split(",")[1:])}

    assert marks(1000)["zyxgroup"] == "generalise" and "plain7" not in marks(1000) and "list" not in marks(1000)
    assert all(marks(2000 + k)["copyword"] == "generalise" for k in range(8))    # eight copies are one document
    assert all(marks(3000 + k)["ownword"] == "remove" for k in range(8))         # eight documents are eight
    assert all(found[k] == "" for k in range(600))


def _rank():
    return np.arange(improbable_digest.LEVELS).astype(np.int32)


def test_window_entropy_equals_the_definition():
    r = np.random.default_rng(1)
    for size, letters in ((64, 3), (200, 30), (1000, 256), (63, 5)):
        buf = r.integers(0, letters, size).astype(np.uint8)
        got = improbable_digest.window_entropy(buf)
        assert len(got) == max(0, size - 63)
        for k, g in enumerate(got):
            c = collections.Counter(buf[k:k + 64].tolist())
            assert abs(g - 1000 * -sum(v / 64 * math.log2(v / 64) for v in c.values()) / 6) <= 0.51


def test_selection_equals_the_definition():
    r = np.random.default_rng(3)
    texts = [bytes(r.integers(97, 97 + k, n).astype(np.uint8)) for k, n in ((5, 400), (26, 700), (2, 64), (9, 130), (1, 300), (4, 20), (4, 0))]
    off = np.append(0, np.cumsum(list(map(len, texts)))).astype(np.int64)
    rank = r.permutation(improbable_digest.LEVELS).astype(np.int32)
    rank[:improbable_digest.LEAST_ENTROPY] = improbable_digest.LEVELS
    pos, doc = improbable_digest._select(np.frombuffer(b"".join(texts), np.uint8), off, rank)
    for d, t in enumerate(texts):
        ranks = [int(rank[e]) for e in improbable_digest.window_entropy(np.frombuffer(t, np.uint8))]
        points = collections.Counter()
        for p in range(len(ranks)):
            run = [(x, q) for q, x in enumerate(ranks[p:p + improbable_digest.RUN], p) if x < improbable_digest.LEVELS]
            if run:
                points[min(run)[1]] += 1
        least = min(improbable_digest.POINTS, max(1, len(ranks) // improbable_digest.FEW))
        want = sorted(q for q, n in points.items() if n >= least)
        if not want and ranks:
            want = [min(range(len(ranks)), key=lambda q: (-points[q], q))]
        assert (pos[doc == d] - off[d]).tolist() == want


def test_digest_likeness():
    r = np.random.default_rng(5)
    words = ["".join(map(chr, r.integers(97, 123, n))) for n in r.integers(2, 9, 3000)]
    a, b = " ".join(words[:1500]), " ".join(words[1500:])
    da, db, dc, de = improbable_digest.digest_texts([a, b, a[:3 * len(a) // 4] + b[:len(a) // 4], ""], _rank())
    assert improbable_digest.likeness(da, da) == 1.0 and improbable_digest.likeness(de, de) == 1.0 and improbable_digest.likeness(da, de) == 0.0
    assert improbable_digest.likeness(da, db) < 0.1 < 0.4 < improbable_digest.likeness(da, dc) < 1
    text = improbable_digest.to_string(da)
    assert improbable_digest.to_string(improbable_digest.from_string(text)) == text and improbable_digest.to_string(de) == ""


def _neighbours(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    texts = [r[1] or "" for r in order]
    out = []
    for k, (i, t) in enumerate(zip([r[0] for r in order], texts)):
        after = texts[(k + 1) % len(texts)]
        out.append((i, t, t[:len(t) - len(t) // 4] + after[:len(t) // 4], after))
    return out


def test_op10_query_and_edge_cases(spark, small_docs, small_rows, edge, edge_rows, nothing):
    for frame, rows in ((small_docs, small_rows), (edge, [r[:2] for r in edge_rows])):
        rank = improbable_digest.entropy_ranks(frame)
        got = improbable_digest.compare_neighbours(frame).collect()
        want = []
        for i, t, e, after in _neighbours(rows):
            a, b, c = improbable_digest.digest_texts([t, e, after], rank)
            want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), improbable_digest.to_string(a), improbable_digest.to_string(b),
                         round(improbable_digest.likeness(a, b), 9), round(improbable_digest.likeness(a, c), 9)))
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9))
                       for r in got), key=str) == sorted(want, key=str)
    assert improbable_digest.compare_neighbours(nothing).count() == 0
    one = improbable_digest.compare_neighbours(small_docs.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert improbable_digest.fingerprint(edge).count() == len(edge_rows)


@pytest.mark.parametrize("lower,trim", [(False, False), (True, False), (True, True)])
def test_split_words_equals_the_pattern(lower, trim, edge_rows):
    from tenderlake.llm.textarrays import split_words
    texts = [r[1] for r in edge_rows] + ["...", "!a! b", " a.b, (c)"]
    w = split_words(pa.array(texts), lower=lower, trim=trim)
    seen = {}
    for d, t in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if lower:
            want = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in want]
        if trim:
            want = [x for x in (x.strip(pii._ENDS) for x in want) if x]
        at = range(w.first[d], w.first[d + 1])
        assert [w.buf[w.start[k]:w.end[k]].tobytes().decode() for k in at] == want
        for k, x in zip(at, want):
            assert seen.setdefault(x, int(w.hash[k])) == int(w.hash[k])
    assert len(set(seen.values())) == len(seen)
