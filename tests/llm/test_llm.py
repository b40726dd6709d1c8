"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeats, empty tables,
clashing extra columns."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import (
    bpe,
    crf_toxicity,
    log_lines,
    mixing,
    order_minhash,
    pii,
    rp_forest,
    sentence_spans,
    simhash,
    warc,
)
from tidewater.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, fp string, k1 string, part string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def table(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", (sources or ["s"])[n % len(sources or ["s"])], None, "x", "y", "z", "p") for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n\n", "a", "a b", "🎉 日本語 ñandú", "word " * 3000, prose(1, 200), prose(1, 200), "no.punctuation" * 200]


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- operator 1


def test_order_minhash_successor_and_edit(spark):
    texts = [*ODD, *[prose(s, 150) for s in range(20)]]
    ids = [3 * i for i in range(len(texts))]
    out = {r["doc_id"]: r for r in rows(order_minhash.edited_pairs(table(spark, texts, ids).repartition(3)))}
    assert len(out) == len(texts)
    order = sorted(ids, reverse=True)
    text = dict(zip(ids, [t or "" for t in texts], strict=True))
    for n, i in enumerate(order):
        nxt, cut = text[order[(n + 1) % len(order)]], len(text[i]) // 3
        edited = text[i][: len(text[i]) - cut] + nxt[:cut]
        assert out[i]["n_chars"] == len(text[i])
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[i]["near_edited"] <= 1 and 0 <= out[i]["near_next"] <= 1
    prints = {}
    for i in ids:
        assert prints.setdefault(text[i], out[i]["fingerprint"]) == out[i]["fingerprint"]
    long = [out[i] for i in ids if len(text[i]) > 500 and len(set(text[i].split())) > 50]
    assert np.mean([r["near_edited"] for r in long]) > 0.1


def likenesses(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    sig = lambda c: order_minhash.signature(F.col(c))
    return [r[0] for r in df.select(order_minhash.likeness(sig("a"), sig("b"))).collect()]


def test_order_minhash_sees_order_and_counts(spark):
    pairs = [("be " * 400, "be " * 20), ("", ""), ("", "a")]
    for n in (20, 60, 300, 2000):
        for seed in range(8):
            w = prose(5 + 100 * seed, n).split()
            pairs.append((" ".join(w), " ".join(w[n // 2 :] + w[: n // 2])))
    got = likenesses(spark, pairs)
    assert got[0] < 0.5 and got[1] == 1.0 and got[2] == 0.0
    moved = [np.mean(got[3 + 8 * i : 11 + 8 * i]) for i in range(4)]
    # halves change places: a pair of places is in order in half of the cases, at every length
    assert all(0.3 < m < 0.7 for m in moved[1:]), moved


def test_order_minhash_realigns_without_spaces(spark):
    r = random.Random(8)
    pairs = []
    for low, high in ((0x4E00, 0x9FA5), (97, 123), (33, 127)):
        t = "".join(chr(r.randrange(low, high)) for _ in range(3000))
        pairs += [("x" + t, t), (t[:1500] + "y" + t[1500:], t), (t[1500:] + t[:1500], t)]
    got = likenesses(spark, pairs)
    for i in range(0, 9, 3):
        assert got[i] >= 0.9 and got[i + 1] >= 0.9 and got[i + 2] < 0.8, got


def plain_units(t):
    """Words of at most 15 characters with the white space before them; longer words by character."""
    out, gap = [], ""
    for part in re.findall(r"\s+|\S+", t, re.ASCII):
        if part.isspace():
            gap = part
        elif len(part) <= 15:
            out.append(gap + part)
            gap = ""
        else:
            out += [gap + part[0], *part[1:]]
            gap = ""
    return [*out, gap] if gap else out


def test_order_minhash_matches_brute_force(spark):
    """Whole signatures by Python dictionaries and sorts over all k-mers."""
    texts = [prose(3, 60) + " " + prose(3, 60), "be " * 50, "x", "one two three four", "a b", " ", "no.punctuation" * 9, prose(1, 700), "日本語 のテキスト" * 40]

    def h64(*values):
        """Spark's xxhash64: every value's hash is the seed of the next one; strings, or (number, bytes)."""
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v[0] % (1 << 8 * v[1])).to_bytes(v[1], "little"), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(order_minhash.signature(F.col("t"))).collect()]
    for t, sig in zip(texts, got, strict=True):
        units = [h64(u) for u in plain_units(t)]
        n = len(units)
        kmers = [h64(*[(u, 8) for u in units[i : i + 3]]) for i in range(n - 2)] or [h64(*[(u, 8) for u in units])]
        count, own = {}, []
        for h in kmers:
            own.append(h64((h >> 31, 8), (count.get(h >> 31, 0), 4)))
            count[h >> 31] = count.get(h >> 31, 0) + 1
        for f in range(21):
            order = []
            for p, v in enumerate(own):
                lane = h64((v, 8), (f // 7, 4)) >> 8 * (f % 7) + 1 & 127
                order.append((lane << 25 | h64((v, 8), (-1 - f, 4)) & (1 << 25) - 1, p))
            least = sorted(sorted(order)[:2], key=lambda x: x[1])
            assert sig[f] == h64(*[(h64((kmers[p], 8), (o, 8)), 8) for o, p in least]) & 0xFFFFFFFF, t


def test_order_minhash_ranges(spark, monkeypatch):
    """Successors over many ranges, with ids that repeat and are null."""
    monkeypatch.setattr(order_minhash, "ROWS", 8)
    r = random.Random(2)
    ids = [r.choice([None, 7, *range(-50, 400)]) if i % 3 else r.choice([None, 7]) for i in range(500)]
    texts = [f"t{i} " + prose(i, 5) for i in range(500)]
    docs = table(spark, texts, ids)
    hashed = {x["text"]: x["h"] for x in rows(docs.select("text", F.xxhash64("text").alias("h")))}
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is None, -(x[0] or 0), hashed[x[1]]))
    want = {t: order[(i + 1) % 500][1] for i, (_, t) in enumerate(order)}
    got = rows(order_minhash.with_successor(docs.repartition(5), F.array(F.lit(1))).select("text", "next_text"))
    assert {x["text"]: x["next_text"] for x in got} == want and len(got) == 500


def test_order_minhash_empty_and_single(spark):
    assert order_minhash.edited_pairs(table(spark, [])).count() == 0
    one = rows(order_minhash.edited_pairs(table(spark, ["only one text here"])))
    assert one[0]["near_next"] == 1.0
    assert order_minhash.edited_pairs(table(spark, ["a", "b", "c"], [None, None, 5])).count() == 3


# --- operator 2


def test_warc_links_and_digests(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/", '<html lang="en"><head><title> T  x</title><meta charset="UTF-8"></head><body><script>no</script><p>One &amp; two</p><a href="/l">l</a></body></html>', "x"), (2, None, None, "x")],
        "page_id bigint, url string, html string, block string",
    )
    response = warc.responses(pages)
    out = rows(warc.serialised(warc.derivatives(response)))
    ids = {r["page_id"]: r["record_id"] for r in rows(response)}
    assert len(out) == 4
    for r in out:
        assert r["refers_to"] == ids[r["page_id"]]
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
        assert r["content_length"] == len(r["block"].encode())
        assert f"WARC-Refers-To: {r['refers_to']}\r\n" in r["record"] and r["record"].endswith("\r\n\r\n")
    text = next(r for r in out if r["page_id"] == 1 and r["record_type"] == "conversion")
    assert text["block"] == "One & two\nl"
    meta = next(r for r in out if r["page_id"] == 1 and r["record_type"] == "metadata")["block"]
    assert "title: T x\r\n" in meta and "outlink: /l\r\n" in meta and "charset: utf-8" in meta
    assert len({r["record_id"] for r in out}) == 4
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def pages_table(spark, recs):
    return spark.createDataFrame(recs, "page_id bigint, url string, html string, block string, place string")


def test_warc_written_files_read_back(spark, tmp_path):
    """Records through files by a plain parser of the format, and responses from files as good as those from tables."""
    long = "<p>" + "long text here " * 60_000 + "</p>"
    recs = [(1, "http://a/", "<html><title>é</title><noscript>a<style>b</style>c</noscript><p>One\r\n\r\nWARC/1.0 two</p></html>", "x", "y"), (2, None, None, "x", "y"), (1, "http://a/", "same", "x", "y"), (1, "http://a/", "same", "x", "y"), (None, "u", long, "x", "y")]
    response = warc.responses(pages_table(spark, recs))
    made = warc.derivatives(response).cache()
    assert made.select("record_id").distinct().count() == made.count() == 10
    warc.write(made.repartition(3), str(tmp_path / "out"))
    got = {}
    for f in (tmp_path / "out").glob("part-*"):
        data = f.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            n = int(fields["Content-Length"])
            assert first == "WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n"
            got[fields["WARC-Record-ID"]] = fields, rest[:n].decode()
            data = rest[n + 4 :]
    assert len(got) == 10
    for r in rows(made):
        fields, block = got[r["record_id"]]
        assert block == r["block"] and fields["WARC-Refers-To"] == r["refers_to"]
        assert fields["WARC-Source-Payload-Digest"].startswith("sha256:")
        assert fields["WARC-Source-Content-Type"] == "application/http; msgtype=response"
    texts = {r["block"] for r in rows(made) if r["record_type"] == "conversion"}
    assert texts == {"One WARC/1.0 two", "", "same", ("long text here " * 60_000).strip()}
    metas = [r["block"] for r in rows(made) if r["record_type"] == "metadata"]
    assert all(m.startswith("http-status: 200\r\n") and "http-header: Content-Type: text/html" in m for m in metas)
    # responses as a WARC file, read back, give the same derivatives but for the page's number
    line = lambda k, v: f"{k}: {v}\r\n" if v is not None else ""
    raw = b""
    for r in rows(response):
        body = (r["http"] + "\r\n" + r["payload"]).encode()
        raw += ("WARC/1.0\r\nWARC-Type: response\r\n" + line("WARC-Record-ID", r["record_id"]) + line("WARC-Target-URI", r["target_uri"]) + line("WARC-Date", r["date"]) + "".join(line(h["name"], h["value"]) for h in r["headers"]) + "\r\n").encode() + body + b"\r\n\r\n"
    raw += b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    import gzip

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(raw))
    back = warc.derivatives(warc.read_responses(spark, str(tmp_path / "in"))).drop("page_id")
    key = lambda df: sorted(map(str, rows(df)))
    assert key(back) == key(made.drop("page_id"))
    own = b"HTTP/1.0 404 Not Found\r\nServer: s\r\n\r\n<p>gone</p>"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: http://b/\r\nWARC-IP-Address: 1.2.3.4\r\nWARC-Block-Digest: sha1:AB\r\nContent-Type: application/http\r\nContent-Length: {len(own)}\r\n\r\n"
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "b.warc").write_bytes(head.encode() + own + b"\r\n\r\n")
    for r in rows(warc.serialised(warc.derivatives(warc.read_responses(spark, str(tmp_path / "one"))))):
        for field in ("WARC-Refers-To: <urn:x>", "WARC-Refers-To-Date: 2020-01-01T00:00:00Z", "WARC-IP-Address: 1.2.3.4", "WARC-Source-Block-Digest: sha1:AB", "WARC-Source-Content-Type: application/http"):
            assert f"\r\n{field}\r\n" in r["record"]
        assert r["block"] == "gone" or r["block"].startswith("http-status: 404\r\n") and "\r\nhttp-header: Server: s\r\n" in r["block"]
    assert warc.derivatives(warc.responses(pages_table(spark, []))).count() == 0


def plain_page(page):
    """Text of a page by the standard HTML parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        hidden, out = None, ""

        def handle_starttag(self, tag, attrs):
            if self.hidden is None and re.fullmatch(f"{warc.HIDDEN}|head", tag):
                self.hidden = tag
            elif self.hidden is None and re.fullmatch(warc.BLOCK, tag):
                self.out += "\0"

        def handle_endtag(self, tag):
            if tag == self.hidden:
                self.hidden = None
            elif self.hidden is None and re.fullmatch(warc.BLOCK, tag):
                self.out += "\0"

        def handle_data(self, data):
            if self.hidden is None:
                self.out += data

    r = Reader(convert_charrefs=True)
    r.feed(page)
    r.close()
    return "\n".join(x for x in (" ".join(p.split()) for p in r.out.split("\0")) if x)


def test_warc_text_equals_html_parser(spark):
    r = random.Random(5)
    tags = ["p", "div", "b", "span", "li", "td", "script", "style", "nav", "em"]
    recs = []
    for i in range(150):
        body = ""
        for _ in range(r.randrange(12)):
            t = r.choice(tags)
            body += f"<{t} class=x>{r.choice(['one two', 'a &amp; b', '&eacute;&#8217;', ' ', 'x' * 9])} {r.choice(['<br>', '', '<!-- no -->'])}{r.choice(WORDS)}</{t}>"
        recs.append((i, "u", f"<html><head><title>t</title></head><body>{body}</body></html>", "x", "y"))
    out = {x["page_id"]: x["block"] for x in rows(warc.derivatives(warc.responses(pages_table(spark, recs))).filter("record_type = 'conversion'"))}
    squeezed = lambda t: "\n".join(" ".join(x.split()) for x in t.split("\n"))
    for i, _, page, *_ in recs:
        assert squeezed(out[i]) == plain_page(page), page


# --- operator 3


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in pii.PLAIN.items():
        for m in re.finditer(pattern, text):
            v, digits = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_matches_plain_patterns(spark):
    r = random.Random(3)
    noise = ["".join(r.choice("a1@.-+ ()%9é🎉\n") for _ in range(r.randrange(60))) for _ in range(300)]
    texts = [*ODD, *noise, "a@b.c%d@e.f 1.2.3.4.5.6.7.8 0000255.1.1.1 256.1.1.1", "+1 (375) 555-4393 card 4207 0512 7910 8084", "1" * 20000, "a" * 20000 + "@", "1." * 20000, "x@" + "a." * 9000 + "b"]
    out = {r["doc_id"]: r for r in rows(pii.digest(table(spark, texts)))}
    for i, t in enumerate(texts):
        want = plain_spans(t or "")
        assert out[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert out[i]["n_email"] == sum(w.startswith("email") for w in want)


def test_pii_many_spans_in_linear_time(spark):
    t = "".join(f"a{i}@b.co " for i in range(30_000))
    r = rows(pii.digest(table(spark, [t])))[0]
    want = plain_spans(t)
    assert r["n_email"] == 30_000 and r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert len(r["scores"].split(",")) == 30_000
    sums = spark.range(1).select(*[pii.running(F.array(*[F.lit(x) for x in range(n)])) for n in (1, 5, 64, 65, 150)]).first()
    for got, n in zip(sums, (1, 5, 64, 65, 150), strict=True):
        assert got == np.cumsum(range(n)).tolist()


def plain_iban(text):
    """Account numbers by remainder of the whole number."""
    out = []
    for m in re.finditer(pii.PATTERNS["iban"], text):
        v = m.group().replace(" ", "")
        n = int("".join(str(int(c, 36)) for c in v[4:] + v[:4]))
        if 15 <= len(v) <= 34 and n % 97 == 1:
            out.append((m.start(), m.end()))
    return out


def test_pii_iban_against_whole_numbers(spark):
    r, texts = random.Random(11), []
    for i in range(200):
        body = "".join(r.choice("0123456789ABCXYZ") for _ in range(r.randrange(11, 30)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + "GB00")) % 97
        v = f"GB{check if i % 3 else (check + 1) % 100:02d}{body}"
        texts.append("pay " + (" ".join(v[j : j + 4] for j in range(0, len(v), 4)) if i % 2 else v) + " now")
    out = {x["doc_id"]: x["spans"] for x in rows(pii.find(table(spark, texts), ("iban",)))}
    found = 0
    for i, t in enumerate(texts):
        assert [(s["start"], s["end"]) for s in out[i]] == plain_iban(t), t
        found += len(out[i])
    assert found > 100


def test_pii_iban_score_and_mask(spark):
    t = "Wire to my bank account GB82 WEST 1234 5698 7654 32 now. Not GB82 WEST 1234 5698 7654 33. Call my phone +1 (375) 555-4393"
    r = rows(pii.find(table(spark, [t])))[0]["spans"]
    kinds = [s["kind"] for s in r]
    assert kinds == ["phone", "iban"]
    assert all(t[s["start"] : s["end"]] == s["value"] for s in r)
    assert r[0]["score"] > pii.BASE_SCORE["phone"] and r[1]["score"] > pii.BASE_SCORE["iban"]
    masked = pii.find(table(spark, [t])).select(pii.mask(F.lit(t), F.col("spans"))).first()[0]
    assert "[phone]" in masked and "[iban]" in masked and "555" not in masked
    assert pii.find(table(spark, [])).count() == 0


# --- operator 4


def brute_mix(recs, share=1.5, passes=2, weights=(3, 1, 2)):
    sizes = {}
    for _, source, size in recs:
        sizes[source] = sizes.get(source, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[i % 3]) for i, s in enumerate(order)}
    cap = {s: passes * sizes[s] for s in order}
    budget, open_ = sum(sizes.values()) * share, set(order)
    while open_:
        level = (budget - sum(cap[s] for s in order if s not in open_)) / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] >= cap[s]}
        if not above:
            return sizes, {s: level * w[s] if s in open_ else float(cap[s]) for s in order}
        open_ -= above
    return sizes, {s: float(cap[s]) for s in order}


def brute_queue(recs, target, sizes, packet, share=1.5, passes=2):
    """Words taken of every record by walking the whole queue."""
    queue, run = [], {}
    for i, s, size in sorted(recs, key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
        start = run.get(s, 0)
        run[s] = start + size
        for p in range(passes):
            for low in range(0, size, packet or size):
                end = min(size, low + (packet or size))
                queue.append(((start + p * sizes[s] + end) / target[s], s is not None, s or "", p, start, low, end - low, i))
    left, took = math.floor(share * sum(sizes.values())), {}
    for x in sorted(queue):
        took[x[7], x[3]] = took.get((x[7], x[3]), 0) + min(left, x[6])
        left -= min(left, x[6])
    return took


def test_mixing_targets_and_takings(spark):
    r = random.Random(1)
    sources = ["a", "b", None, "é", "c", "z"]
    texts = [prose(i, r.randrange(1, 120)) for i in range(200)] + [None, "", "  \t", prose(7, 3000)]
    recs = [(i, sources[i % 6] if i % 3 else "a", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, s, "clash") for i, s, t in recs], "doc_id bigint, text string, source string, place string")
    out = rows(mixing.taken_words(df.repartition(4)))
    size = {i: len((t or "").split()) for i, _, t in recs}
    sized = [(i, s, size[i]) for i, s, _ in recs]
    sizes, target = brute_mix(sized)
    of = {i: s for i, s, _ in recs}
    want = brute_queue(sized, target, sizes, mixing.PACKET)
    took = {}
    for x in out:
        i, s = x["doc_id"], of[x["doc_id"]]
        assert x["size"] == size[i] and x["source_size"] == sizes[s]
        assert math.isclose(x["target"], target[s])
        assert x["taken"] == want.get((i, 0), 0) + want.get((i, 1), 0) <= 2 * x["size"]
        took[s] = took.get(s, 0) + x["taken"]
    assert len(out) == len(texts)
    assert sum(took.values()) == math.floor(1.5 * sum(sizes.values()))
    assert all(abs(took[s] - target[s]) <= 1000 for s in target)
    again = rows(mixing.taken_words(df.repartition(7)))
    key = lambda x: (x["doc_id"], x["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_mixing_is_cut_at_the_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS", 16)  # many ranges
    df = table(spark, [prose(i, 20 + i) for i in range(60)] + ["dup text", "dup text", None, None], [*range(60), 99, 99, None, None], ["a", "b"])
    m = sorted((x for x in rows(mixing.mix(df)) if x["words"]), key=lambda x: x["position"])
    budget, at = math.floor(1.5 * sum(x["words"] for x in m if x["pass"] == 0)), 0
    assert [x["finish"] for x in m] == sorted(x["finish"] for x in m)
    for x in m:
        assert x["position"] == at and x["taken"] == max(0, min(x["words"], budget - at))
        at += x["words"]
    assert at > budget and sum(x["taken"] == 0 for x in m) > 10  # the cut leaves rows out
    assert any(0 < x["taken"] < x["words"] for x in m) or budget in {x["position"] for x in m}


def test_mixing_resample(spark):
    texts = [prose(i, 20 + i) for i in range(60)] + ["dup text", "dup text", None]
    ids, names = [*range(60), 99, 99, None], ["a", "b"]
    df = table(spark, texts, ids, names)
    got = mixing.resample(df)
    assert got.columns == df.columns
    sized = [(i, names[n % 2], len(t.split())) for n, (i, t) in enumerate(zip(ids, texts, strict=True)) if i is not None and i < 99]
    counts = {}
    for x in rows(got):
        counts[x["doc_id"]] = counts.get(x["doc_id"], 0) + 1
    assert max(v for k, v in counts.items() if k != 99) <= 2 and counts[None] == 1
    words = sum(counts.get(i, 0) * size for i, _, size in sized)
    assert 0 <= 1.5 * sum(size for *_, size in sized) - words <= 200
    clash = df.select("doc_id", "text", "source", F.lit(1).alias("__times"), F.lit(2).alias("__n"))
    assert {(r["__times"], r["__n"]) for r in rows(mixing.resample(clash))} == {(1, 2)}
    assert mixing.taken_words(table(spark, [])).count() == 0 and mixing.resample(table(spark, [])).count() == 0


# --- operator 5


def plain_sentences(text, long):
    """Character by character: sentences, and clauses of those of more than ``long`` words, as tuples of words."""

    def cut(t, ends, wide, lines):
        out, now = [], ""
        for i, c in enumerate(t):
            last = i + 1 == len(t) or t[i + 1].isspace()
            more = i + 1 < len(t) and t[i + 1] in ends + wide
            now += c
            if (c in ends and last) or (c in wide and not more and now.strip(ends + wide + " ")) or (lines and c == "\n"):
                out.append(now)
                now = ""
        return [x for x in [*out, now] if x.strip()]

    out = []
    for s in cut(text, ".!?", "。！？", True):
        parts = cut(s, ",;:", "", False) if len(s.split()) > long else [s]
        out += [tuple(p.split()) for p in parts]
    return out


def brute_spans(docs, n, long):
    """Sentences to drop of every document by its key: those that a run covers that stands earlier."""
    seen, drop = set(), {}
    for key in sorted(docs):
        parts = plain_sentences(docs[key], long)
        for i in range(len(parts) - n + 1):
            run = tuple(parts[i : i + n])
            if run in seen:
                drop.setdefault(key, set()).update(range(i, i + n))
            seen.add(run)
    return drop


def test_sentence_spans_against_brute_force(spark):
    passage = " ".join(prose(100 + i, 13).capitalize() + "." for i in range(5))
    texts = [f"{prose(i, 9)}. {passage} {prose(50 + i, 12)}." if i % 3 == 0 else " ".join(prose(200 + i * 10 + j, 8) + "." for j in range(6)) for i in range(30)]
    clauses = ", ".join(prose(700 + i, 7) for i in range(6)) + "."
    texts += [*ODD, "Half. " + passage[40:], ". . ! ?\n\n...", clauses, "Yes. " + clauses + " No.", "A. B. C. A. B. C.", "一二三。四五。六七！八九。", "零。一二三。四五。六七！八"]
    df = table(spark, texts).repartition(4)
    out = {r["doc_id"]: r for r in rows(sentence_spans.clean(df))}
    want = brute_spans({i: t or "" for i, t in enumerate(texts)}, 3, 20)
    for i, t in enumerate(texts):
        assert out[i]["__removed"] == sorted(want.get(i, [])), t
        assert out[i]["__n_sentences"] == len(plain_sentences(t or "", 20))
        if not out[i]["__removed"]:
            assert out[i]["text"] == t
        left = [w for j, s in enumerate(plain_sentences(t or "", 20)) if j not in want.get(i, []) for w in s]
        assert "".join((out[i]["text"] or "").split()) == "".join(left)
    assert passage in out[0]["text"]
    kept = sum(passage.split(". ")[2] in (out[i]["text"] or "") for i in range(0, 30, 3))
    assert kept == 1
    assert out[texts.index(None)]["text"] is None
    assert out[texts.index("A. B. C. A. B. C.")]["text"].split() == ["A.", "B.", "C."]
    assert sentence_spans.clean(table(spark, [])).count() == 0


def test_sentence_spans_columns_and_repeated_rows(spark):
    t = "One here. Two here. Three here."
    df = spark.createDataFrame([(1, t, "a", 5), (1, t, "a", 5), (None, t, "b", 6), (2, t, "c", 7)], "doc_id bigint, text string, __k1 string, __runs int")
    out = rows(sentence_spans.clean(df))
    assert len(out) == 4 and {r["__k1"] for r in out} == {"a", "b", "c"}
    assert {(r["doc_id"], r["__n_removed"]) for r in out} == {(None, 0), (1, 3), (2, 3)}


def test_sentences_cover_text():
    for t in ["A b. C d! E", "x.y z? \n q", "", "...", "no end", "One.\nTwo\n\nThree.", "a, " * 30 + "b; c:d, 1,000."]:
        joined = "".join(t[a:b] for a, b in sentence_spans.sentences(t))
        assert re.sub(r"\s", "", joined) == re.sub(r"\s", "", t)


# --- operator 6


def test_bpe_equals_tiktoken():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.public_vocabulary()
    tokens = bpe.read_ranks(path)
    codec = bpe.Codec(tokens, bpe.model_bytes(tokens), pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    r = random.Random(2)
    texts = [t or "" for t in ODD] + ["<|endoftext|> <unk> ▁▁ _", "a" * 5000, " " * 3000 + "x", "don't I'LL 12345 3.14", "\x00\x01\x7f ­"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2FF), r.randrange(0x4E00, 0x4F00)])) for _ in range(200)) for _ in range(50)]
    for t in texts:
        ids = codec.encode(t)
        assert memoryview(ids).cast("I").tolist() == enc.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_bpe_round_trip(spark):
    df = table(spark, ODD)
    args = bpe.public_vocabulary()
    out = {r["doc_id"]: r for r in rows(bpe.round_trip(df, *args))}
    for i, t in enumerate(ODD):
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, *args).drop("text"), *args)
    assert {r["doc_id"]: r["text"] for r in rows(back)} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.round_trip(table(spark, []), *args).count() == 0


# --- operator 7


def brute_fp(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def find_all(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_simhash_against_brute_force(spark):
    base = prose(9, 400)
    near = [base.replace(w, "changed", 1) for w in base.split()[:40:2]]
    texts = [*near, *ODD, base, base.upper(), *[prose(300 + i, 30) for i in range(40)]]
    out = {r["doc_id"]: r for r in rows(simhash.link(table(spark, texts).repartition(5)))}
    fps = [brute_fp(t) for t in texts]
    root = find_all(len(texts), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for i in range(len(texts)):
        assert out[i]["fingerprint"] == f"{fps[i]:016x}" and out[i]["component_id"] == root[i]
    kept = rows(simhash.representatives(table(spark, texts)))
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root))
    nulls = rows(simhash.representatives(table(spark, ["same text here again"] * 3, [None, None, 4])))
    assert [r["doc_id"] for r in nulls] == [4]
    assert simhash.link(table(spark, [])).count() == 0


def test_bit_sliced_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    for n, groups in ((2, 1), (130, 1), (700, 9)):
        fps = rng.integers(0, 2**63, n, dtype=np.uint64)
        fps[1::3] = fps[0 : len(fps[1::3]) * 3 : 3] ^ np.uint64(0b1011)
        g = np.sort(rng.integers(0, groups, n))
        got = {p for a, b in simhash._within(fps, g, 4) for p in zip(a.tolist(), b.tolist(), strict=True)}
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if g[i] == g[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
        assert got == want


def test_simhash_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    center = 0x0123456789ABCDEF
    fps = [center ^ (1 << i) ^ (1 << (i * 7 % 60)) for i in range(60)]
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = rows(simhash.stars(spark.createDataFrame([(f,) for f in set(fps)], "fp bigint")))
    at = {f: i for i, f in enumerate(sorted(set(fps)))}
    assert len(set(find_all(len(at), [(at[e["a"]], at[e["b"]]) for e in edges]))) == 1


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(5, 5)]
    out = {r["node"]: r["root"] for r in rows(components(spark.createDataFrame(edges, "a bigint, b bigint")))}
    assert all(out[i] == 0 for i in range(41)) and all(out[i] == 100 for i in range(100, 160))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- operator 8


def brute_lines(texts, depth=3, min_docs=10, constant=0.6):
    docs = {}
    for i, t in enumerate(texts):
        docs.setdefault(t or "", []).append(i)
    lines = {}  # line -> texts
    for t in docs:
        for line in set(t.split("\n")):
            if line.strip(" \t\x0b\x0c\r"):
                lines.setdefault(line, set()).add(t)
    mask = lambda w: "<*>" if re.search("[0-9]", w) else w
    toks = {x: [mask(w) for w in x.split()] for x in lines}
    leaf = {x: (len(toks[x]), tuple(toks[x][:depth])) for x in lines}
    in_leaf = {}
    for x, ts in lines.items():
        in_leaf.setdefault(leaf[x], set()).update(ts)
    support = {}
    for x, ts in lines.items():
        for p, w in enumerate(toks[x]):
            if p >= depth:
                support[leaf[x], p, w] = support.get((leaf[x], p, w), 0) + len(ts)
    template, seen = {}, {}
    for x, ts in lines.items():
        if len(in_leaf[leaf[x]]) < min_docs:
            continue
        real = [(p, w) for p, w in enumerate(toks[x]) if w != "<*>"]
        fixed = [(p, w) for p, w in real if p >= depth and support[leaf[x], p, w] >= min_docs]
        if len(fixed) + sum(p < depth for p, _ in real) >= constant * len(toks[x]):
            template[x] = (leaf[x], tuple(fixed))
            seen.setdefault(template[x], set()).update(ts)
    return {x: k for x, k in template.items() if len(seen[k]) >= min_docs}


def test_log_lines_against_brute_force(spark):
    r = random.Random(4)
    texts = []
    for i in range(60):
        parts = [prose(i * 10 + j, 8) for j in range(4)]
        if i % 3 == 0:
            parts.insert(1, f"Posted by user{i} at {i}:15 in the general forum today")
        if i % 4 == 0:
            parts.append("All rights reserved.")
        if i < 5:
            parts.append("Rare footer line here")
        r.shuffle(parts)
        texts.append("\n".join(parts))
    texts += [*ODD, texts[0], texts[0]]
    df = table(spark, texts).repartition(4)
    out = {x["doc_id"]: x for x in rows(log_lines.clean(df))}
    doomed = brute_lines(texts)
    assert any("Posted" in x for x in doomed) and not any("Rare" in x for x in doomed)
    firsts = set()
    for i, t in enumerate(texts):
        want = []
        for line in (t or "").split("\n"):
            if line in doomed and doomed[line] in firsts:
                continue
            if line in doomed:
                firsts.add(doomed[line])
            want.append(line)
        assert (out[i]["text"] or "") == "\n".join(want)
    assert log_lines.clean(table(spark, [])).count() == 0


# --- operator 9


def test_rp_forest_recall_and_exactness(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[700:] += rng.integers(0, 5, (800, 1)) * 4
    x[10] = x[20]
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 0), (5100, [0.0] * 16, 0), (5200, [float("nan")] * 16, 0), (5300, [], 0), (5400, [None, *[1.0] * 15], 0)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, leaf int").repartition(4)
    out = rows(rp_forest.search(df, F.col("vec_id") % 100 == 0))
    x = x.astype(np.float32).astype(float)
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        top = np.lexsort((np.arange(1500), d))[:10]
        got = sorted([r for r in out if r["query_id"] == q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert all(math.isclose(r["score"], d[r["vec_id"]], rel_tol=1e-12) for r in got)
        hit += len({r["vec_id"] for r in got} & set(top.tolist()))
    assert hit / 150 >= 0.9 and {r["query_id"] for r in out} == set(range(0, 1500, 100))
    few = rows(rp_forest.search(df.filter("vec_id < 5"), F.col("vec_id") % 100 == 0))
    assert len(few) == 4
    assert rp_forest.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# --- operator 10


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    e, trans = rng.normal(size=6), rng.normal(size=3)
    weights = np.zeros(6)
    total = 0.0
    for y in product((0, 1), repeat=6):
        s = sum(e[i] * y[i] for i in range(6)) + sum({(0, 0): 0, (0, 1): trans[0], (1, 0): trans[1], (1, 1): trans[2]}[y[i], y[i + 1]] for i in range(5))
        total += math.exp(s)
        weights += math.exp(s) * np.array(y)
    f, b = crf_toxicity._forward_backward(e[None], np.ones((1, 6), bool), trans)
    assert np.allclose(crf_toxicity._sigmoid(f + b)[0], weights / total)


def test_toxicity_held_out_accuracy(spark):
    import zlib

    r = random.Random(6)
    bad = ["grubble", "snark", "vileword", "mudface"]
    texts, labels = [], []
    for i in range(600):
        words = prose(1000 + i, 60).split()
        y = int(i % 4 == 0)
        if y:
            for _ in range(3):
                words.insert(r.randrange(60), r.choice(bad))
        texts.append(" ".join(words[:30]) + ". " + " ".join(words[30:]))
        labels.append((i, 1, y))
    docs = table(spark, [*texts, None, "", "MUDFACE! snark"])
    lab = spark.createDataFrame([*labels, (9999, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    out = {x["doc_id"]: x for x in rows(crf_toxicity.score(docs, lab))}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] == (i in set(held)) for i in range(600))
    assert np.mean([out[i]["predicted"] == labels[i][2] for i in held]) > 0.97
    assert out[600]["predicted"] == 0 and out[601]["predicted"] == 0 and out[602]["predicted"] == 1
    a, b = map(int, out[602]["spans"].split(",")[0].split(":"))
    assert "MUDFACE! snark"[a:b] == "MUDFACE"
    none = rows(crf_toxicity.score(docs.limit(3), lab.limit(0)))
    assert all(x["score"] == 0 for x in none)
    assert crf_toxicity.score(table(spark, []), lab).count() == 0
    clean = crf_toxicity.accepted(docs, lab)
    assert clean.columns == docs.columns and clean.count() < 603


def small_model():
    rng = np.random.default_rng(4)
    weights = rng.normal(size=crf_toxicity.BUCKETS + 1).astype(np.float32)
    weights[-1] = 0
    return crf_toxicity.Model(weights, -0.5, np.array([0.3, -0.2, 0.8]), np.array([0.1, 0.7, 0.4]), None)


def brute_score(model, text):
    """Document score and spans by enumerating all taggings of each sentence."""
    from itertools import product

    marks = []
    for m in re.finditer(r"[^.!?\n]+", text):
        words = [("".join(c.lower() if len(c.lower()) == 1 else c for c in w.group()), w.start() + m.start(), w.end() + m.start()) for w in re.finditer(r"\w+", m.group())]
        feats = [crf_toxicity._features(w) for w, *_ in words]
        n = len(words)
        if not n:
            continue
        e = []
        for i in range(n):
            x = float(model.bias) + sum(float(model.weights[f]) for f in feats[i][:5])
            x += float(model.weights[feats[i - 1][5]]) if i else 0
            x += float(model.weights[feats[i + 1][6]]) if i + 1 < n else 0
            e.append(x)
        pair = {(0, 0): 0, (0, 1): model.trans[0], (1, 0): model.trans[1], (1, 1): model.trans[2]}
        total, each = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=n):
            v = math.exp(sum(a * b for a, b in zip(e, y, strict=True)) + sum(pair[y[i], y[i + 1]] for i in range(n - 1)))
            total += v
            each += v * np.array(y)
        marks += [(p / total, a, b) for p, (_, a, b) in zip(each, words, strict=True)]
    top = sorted((p for p, *_ in marks), reverse=True)[:2]
    x = [1.0] + [math.log(c / (1 - c)) for c in (min(max(p, 1e-3), 1 - 1e-3) for p in top + [0.0] * (2 - len(top)))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.head, strict=True)))), [(a, b) for p, a, b in marks if p >= 0.5]


def test_toxicity_scores_and_spans_against_enumeration(spark):
    model, r = small_model(), random.Random(9)
    texts = ["", "...", "İİİ one İTwo", "ÑANDÚ 日本語 x", "ẞß Straße! İx"]
    texts += [". ".join(" ".join(r.choice(WORDS).title() for _ in range(r.randrange(1, 8))) for _ in range(r.randrange(1, 4))) for _ in range(40)]
    out = {x["doc_id"]: x["t"] for x in rows(crf_toxicity.scored(table(spark, texts), model, "t"))}
    for i, t in enumerate(texts):
        score, bad = brute_score(model, t)
        assert math.isclose(out[i]["score"], score, rel_tol=1e-5), t
        got = [tuple(map(int, x.split(":"))) for x in out[i]["spans"].split(",") if x]
        assert {p for a, b in got for p in range(a, b)} >= {p for a, b in bad for p in range(a, b)}
        assert {a for a, _ in got} <= {a for a, _ in bad} and {b for _, b in got} <= {b for _, b in bad}


def test_toxicity_long_sentences_and_repeated_rows(spark):
    model = small_model()
    long = prose(1, 5000)
    whole = model.marginals([long])[0]
    f, b = crf_toxicity._forward_backward(np.array([model._emissions(model.known.numbers(crf_toxicity.tokens(long)), np.zeros(5000, int))]), np.ones((1, 5000), bool), model.trans)
    assert np.allclose(whole, crf_toxicity._sigmoid(f + b)[0])
    out = rows(crf_toxicity.scored(table(spark, [*ODD, long, long], [1] * (len(ODD) + 2)), model, "t"))
    by_text = {}
    for x in out:
        assert by_text.setdefault(x["text"], x["t"]) == x["t"]


def test_toxicity_gradient(spark):
    """The log-likelihood of tagged sentences rises from the start to the fitted model."""
    texts = ["good day vileword here", "nice vileword vileword", "good day here", "nice day again"] * 200
    texts = [f"{t} w{i % 97}" for i, t in enumerate(texts)]
    labels = [int("vileword" in t) for t in texts]
    m = crf_toxicity.fit(texts, labels)
    p = m.marginals(["good day vileword here", "good day here"])
    assert p[0][2] > 0.9 and max(p[0][[0, 1, 3]]) < 0.5 and p[1].max() < 0.5


# --- the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    base = [prose(i, 120) for i in range(40)]
    texts = [*base, base[0], base[1] + " tail9", None, ""]
    df = table(spark, texts, sources=["a", "b", "c"]).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = df
    clash = ["__k1", "__k2", "__id", "__n", "__times", "__skey", "__drop", "__new", "__tox", "__n_lines", "k1", "part", "size", "fp"]
    for name, stage in corpus_pipeline.STAGES:
        odd = table(spark, [*ODD, prose(9, 20000), prose(9, 20000)], [*range(len(ODD)), None, None]).select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(c) for i, c in enumerate(clash)])
        got = stage(spark, odd, str(tmp_path))
        if name != "byte_bpe":
            assert got.columns == odd.columns, name
            assert all(r[c] == i for r in rows(got) for i, c in enumerate(clash)), name
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 20 < out.count() <= 88
    assert all(len(r["token_ids"]) == r["n_tokens"] for r in rows(out))


def edited(text, every, seed):
    """text with a changed word at each so many words."""
    words = text.split()
    for at in range(seed % every, len(words), every):
        words[at] = f"changed{seed}x{at}"
    return " ".join(words)


def brute_near(texts, shingle=5, similarity=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    near = lambda a, b: a == b or len(a & b) >= similarity * len(a | b) - 1e-9
    return find_all(len(texts), [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])])


def test_pipeline_drops_near_copies_at_jaccard(spark):
    import corpus_pipeline

    base = [prose(i, 400) for i in range(6)]
    texts = [*base, *[edited(t, every, 7 * i + every) for i, t in enumerate(base) for every in (25, 40, 46, 50, 60, 100)], *ODD, prose(77, 4), prose(77, 4).upper()]
    texts += [edited(base[0], 50, 1), edited(edited(base[0], 50, 1), 50, 26), edited(edited(edited(base[0], 50, 1), 50, 26), 50, 12)]
    df = table(spark, texts).repartition(3)
    want = sorted(set(brute_near(texts)))
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in rows(got)) == want
    strict = rows(simhash.representatives(df))
    assert len(want) < len(strict)
    assert corpus_pipeline.near_dedup(spark, table(spark, []), "").count() == 0
    twice = corpus_pipeline.near_dedup(spark, table(spark, ["same text here again"] * 3, [None, 4, 4]), "")
    assert [r["doc_id"] for r in rows(twice)] == [4]


def test_near_copies_tiles(spark, monkeypatch):
    from tidewater.llm import near_copies

    monkeypatch.setattr(near_copies, "TILE", 900)
    base = prose(8, 300)
    texts = [edited(base, 75, i) for i in range(25)] + [edited(base, 3, 2), prose(9, 300)]
    got = rows(near_copies.representatives(table(spark, texts)))
    assert sorted(r["doc_id"] for r in got) == sorted(set(brute_near(texts)))


def test_near_copies_by_fingerprints(spark):
    """Operator 7's steps alone, without any band, give the pairs within its radius, and the exact check decides."""
    from tidewater.llm import near_copies

    base = [prose(50 + i, 1500) for i in range(4)]
    texts = [*base, *[t + " tail" for t in base], prose(60, 1500), None, ""]
    docs = table(spark, texts)
    fps = [simhash.of_hashes(near_copies.shingles(t)) for t in texts]
    assert all((fps[i] ^ fps[i + 4]).bit_count() <= 4 for i in range(4))
    different = near_copies._different(near_copies.signatures(docs)).withColumn("bands", F.array().cast("array<bigint>"))
    different.cache()
    ids = {r["same"]: r["least"]["id"] for r in rows(different)}
    got = {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in rows(near_copies._edges(docs, different, 5, 0.8))}
    assert got == {(i, i + 4) for i in range(4)}
    assert rows(near_copies._edges(docs, different, 5, 0.9999)) == []


def test_log_lines_identical_and_numeric(spark):
    same = ["Tel. 555 123 4567", "(c) 2019 2020 2021", "2024 10 12", "x1 y2"]
    forms = ["Posted {0} May 2021 at 10:{0}", "Page {0} of 10", "2024-01-{0} 10:22:33 INFO GET 200 {0}ms"]
    texts = []
    for i in range(12):
        texts.append("\n".join([f"own{i} words {i} here", *same, *[f.format(i) for f in forms], f"{i} {i}7 {i}8"]))
    texts += ["Rare 1 2 3"] * 3
    out = {x["doc_id"]: x["text"].split("\n") for x in rows(log_lines.clean(table(spark, texts)))}
    for i in range(12):
        lines = texts[i].split("\n")
        assert out[i] == (lines if i == 0 else [lines[-1]])  # "own<i> words <i> here" is a template as well
    assert out[12] == ["Rare 1 2 3"]


def test_warc_references_and_links(spark):
    page = """<html><head><title>Caf&eacute; &#8217;s &amp; Co</title></head><body><p>&copy; 2020 &middot; &#x27;a&#39; &amp;lt; caf&eacute;</p>
    <a href="/a?x=1&amp;y=2">1</a><a class=c href='/b'>2</a><A HREF=/c>3</A><a href="/d?a=1&copy=2">4</a><a data-href="/no">5</a></body></html>"""
    out = rows(warc.derivatives(warc.responses(spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string"))))
    block = {r["record_type"]: r["block"] for r in out}
    assert block["conversion"].split("\n")[0] == "© 2020 · 'a' &lt; café"
    assert block["metadata"].startswith("http-status: 200\r\ntitle: Café ’s & Co\r\n")
    assert [x[9:] for x in block["metadata"].split("\r\n") if x.startswith("outlink: ")] == ["/a?x=1&y=2", "/b", "/c", "/d?a=1&copy=2"]
