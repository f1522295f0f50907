"""The training-data operators against brute force on small fixtures with nulls, empties, ties, repeats and long texts."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tessera.llm")
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
random.seed(5)
WORDS = ["thea", "ention", "ouair", "über", "nd", "le", "que", "ing", "été", "straße", "loser", "xx"]


def prose(n):
    return " ".join(random.choice(WORDS) + random.choice(["", ",", ".", ""]) for _ in range(n))


BASE = prose(120)
ROWS = [(i, prose(random.randrange(1, 90))) for i in range(60)] + [
    (100, None), (101, ""), (102, " \n\t"), (103, BASE), (104, BASE), (104, BASE), (105, BASE + " tail"), (106, prose(3000)), (None, "no id here"), (107, "One"), (108, "x" * 20_000), (109, "it's <|endoftext|> é ﬁ ½ 12"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns clash with names that operators use."""
    rows = [(i, t, "en", "s", 0, 1.0, "k") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, term string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x in ROWS]


def crc(x):
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


def key(x):
    return (x is None, x or 0)


def test_sharding(docs, empty):
    from tessera.llm.sharding import shard_documents

    rows = shard_documents(docs, 8).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS if i is not None)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert shard_documents(empty).count() == 0


def test_packing(docs, empty, ids):
    from tessera.llm.packing import pack_documents

    rows = pack_documents(docs, VOCABULARY, waiting=3000).collect()
    pieces, windows = {}, {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier))
        pieces.setdefault((key(r.doc_id), r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for w in windows.values():
        at = 0
        for o, n, _ in sorted(w):
            assert o == at
            at += n
        assert at == w[0][2] <= 2048 and at & (at - 1) == 0
    want = {}
    for i, x in ids:
        want.setdefault((key(i), len(x)), []).append(x)
    for k, xs in want.items():
        got = sorted(pieces[k])
        assert sum(n for _, n, _ in got) == len(xs[0]) * len(xs)
        assert all(crc(xs[0][a : a + n]) == c for a, n, c in got)
    assert pack_documents(empty, VOCABULARY).count() == 0


def test_token_store(spark, docs, empty, ids, tmp_path):
    from tessera.llm.token_store import read_ids, read_summary, write_store

    for name, rows, want in (("a", docs, ids), ("b", empty, [])):
        path = f"file://{tmp_path}/{name}"
        write_store(rows, path, VOCABULARY, 3)
        got = sorted(read_summary(spark, path).collect(), key=lambda r: r.start)
        assert sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((key(i), len(x), crc(x)) for i, x in want)
        assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
        known = [r.doc_id for r in got if r.doc_id is not None]
        assert known == sorted(known)
        assert sorted((key(r.doc_id), r.ids) for r in read_ids(spark, path).collect()) == sorted((key(i), x) for i, x in want)


def test_wrong_chunk_is_found():
    from tessera.llm.token_store import _chunks, _batch, digest, pa

    bad = _batch([(digest(b"\x02ab"), b"\x02ac")], "digest, payload", [pa.binary(), pa.binary()])
    with pytest.raises(ValueError):
        list(_chunks(iter([bad])))


def brute_components(rows, width, distance):
    fp = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        s = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fp.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= distance:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return sorted((key(r[0]), format(f, "016x"), key(least[g])) for r, f, g in zip(rows, fp, group))


@pytest.mark.parametrize("shard,block", [(16_384, 65_536), (8, 6)])
def test_simhash(docs, empty, shard, block):
    from tessera.llm.simhash import near_duplicates

    got = near_duplicates(docs, 4, 4, shard, block).collect()
    assert sorted((key(r.doc_id), r.fingerprint, key(r.component_id)) for r in got) == brute_components(ROWS, 4, 4)
    assert near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(docs, empty):
    from tessera.llm.simhash import drop_near_duplicates

    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert kept.count(103) == 1 and not {104, 105, 101, 102} & set(kept) and 106 in kept and 100 in kept
    assert drop_near_duplicates(empty).count() == 0


def test_near_copies_are_exact(spark):
    """Pairs on both sides of 0.8, a repeated line, chains and large groups, against brute force."""
    from tessera.llm.simhash import drop_near_duplicates

    g = random.Random(7)
    word = lambda: "".join(g.choice("abcdefghijklmnop") for _ in range(8))
    rows, shingles = [], []
    for k in range(160):
        base = [word() for _ in range(g.choice((12, 60, 304)))]
        # A tail shared by no other text leaves a similarity of n / (n + tail) of shingles.
        n = len(base) - 4
        tail = g.choice((n // 4, n // 4, n // 4 + 1, n // 5, n // 3))
        rows += [" ".join(base), " ".join(base + [word() for _ in range(tail)])]
    line = " ".join(word() for _ in range(7))
    rows += [" ".join([line] * 400 + [word() for _ in range(300)]) for _ in range(4)]
    base = [word() for _ in range(100)]
    rows += [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(100)]
    group = list(range(len(rows)))
    for r in rows:
        w = r.split()
        shingles.append({" ".join(w[k : k + 5]) for k in range(len(w) - 4)})
    for i in range(len(rows)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) * 5 >= 4 * len(shingles[i] | shingles[j]):
                group = [group[j] if x == group[i] else x for x in group]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    for small in ({}, {"sets": 16}):
        assert {r.doc_id for r in drop_near_duplicates(df, **small).collect()} == {min(i for i in range(len(rows)) if group[i] == x) for x in set(group)}


def test_nearest(spark):
    from tessera.llm.ann import nearest

    g = np.random.default_rng(1)
    x = g.standard_normal((1500, 24)) * g.uniform(0.5, 2, (1500, 1))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))] + [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] * 24), (2080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(df, F.col("vec_id") % 20 == 0, 10, shard=500, block=40).collect()
    y = x.astype(np.float32).astype(float)
    hit = 0
    for q in range(0, 1500, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(abs(r.score - y[q] @ y[r.vec_id]) < 1e-9 for r in own)
        s = y @ y[q]
        s[q] = -np.inf
        hit += len({r.vec_id for r in own} & set(np.argsort(-s)[:10].tolist()))
    assert hit / 750 >= 0.9 and {r.query_id for r in got} == set(range(0, 1500, 20))
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


EDGES = ["a@b.com_x@y.com.z", "a@b@c.d", "1.2.3.4.5.6.7.8", "0000255.1.2.3 256.1.1.1", "4111 1111 1111 1111", "1 4111 1111 1111 1111 2", "+1 (234) 567-8901.", "+1++1234567890", "é😀 a@b.co 9.9.9.9", None, "", "12 34  4111111111111111", "a" * 30_000 + "@", "1 " * 9_000]


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t if len(t) < 20_000 else "")]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_personal_data(spark, empty):
    from tessera.llm.privacy import find_personal_data, sanitise

    df = spark.createDataFrame(list(enumerate(EDGES)), "doc_id long, text string")
    for r in find_personal_data(df).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(EDGES[r.doc_id] or ""))
        assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert {r.doc_id: r.text for r in sanitise(df).collect()}[8] == "é😀 [EMAIL] [IP]"
    assert find_personal_data(empty).count() == 0 and sanitise(empty).columns == empty.columns


def test_disclosing_terms(spark):
    from tessera.llm.privacy import find_personal_data

    rows = [(i, f"hello kontakt{'' if i % 9 else 'e'} u{i}@x.org and more text") for i in range(40)] + [(100 + i, "hello and more text") for i in range(200)]
    got = {r.doc_id: r.spans for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].endswith("term:6:13") and "term" not in got[100]


def test_rare_and_hot_disclosing_terms(spark):
    """A term that is only beside one address in two documents, and one beside a kind that most documents hold."""
    from tessera.llm.privacy import find_personal_data

    g = random.Random(3)
    some = lambda n: " ".join("w" + "".join(g.choice("abc") for _ in range(3)) for _ in range(n))
    # Every third document has a phone, six of ten an address in a footer beside a word of its own.
    texts = [some(40) + (f" zentrale {'x' * (1 + i % 7)}{i}@hub.org " if i % 10 < 6 else " ") + some(20) + (f" +1 234 567 {8000 + i}" if i % 3 == 0 else "") for i in range(300)]
    for i in (7, 18):
        texts[i] = some(30) + " kowalska k@mail.org " + some(30)
    texts[9] += " einmalig z9@mail.org"
    for i in (28, 48):
        texts[i] += " " + some(4) + " fern " + some(4) + f" y{i}@mail.org"
    got = {r.doc_id: r.spans for r in find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = {texts[i][int(a) : int(b)] for i, s in got.items() for k, a, b in (x.split(":") for x in s.split(",") if x) if k == "term"}
    assert found == {"zentrale", "kowalska"}


def test_toxicity(spark, docs, empty):
    from tessera.llm.toxicity import drop_toxic, score_toxicity

    rows = [(i, prose(40) + (" vileword " if i % 5 == 0 else " ") + prose(20)) for i in range(600)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(df, labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 600]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got.values())
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95 and 0 <= got[900].score <= 1
    assert {r.doc_id for r in drop_toxic(df, labels).collect()} == {i for i, r in got.items() if r.predicted == 0}
    assert score_toxicity(docs, labels.limit(0)).filter("score <> 0").count() == 0 and drop_toxic(empty, labels).count() == 0


def test_all_sequences_count(spark, monkeypatch):
    """More sequences than a task holds change nothing."""
    from tessera.llm import toxicity

    rows = [(i, prose(30) + (f" {w[i % 4]} " if i % 5 == 0 else " ") + prose(10)) for w in [("vileword", "nastig", "übel", "wrzgh")] for i in range(400)] + [(900, None), (901, ""), (399, BASE)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    want, got = [], []
    for most, out in ((1_000_000, want), (20, got)):
        monkeypatch.setattr(toxicity, "GRAMS", most)
        out += sorted((r.doc_id, r.held_out, r.score, r.predicted) for r in toxicity.score_toxicity(df, labels).collect())
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-5)


def test_all_labelled_rows_count(spark):
    """A toxic word that only the labels of fold 3 hold is known."""
    from tessera.llm.toxicity import score_toxicity

    part = lambda i: zlib.crc32(str(i).encode()) % 4
    bad = lambda i: i % 3 == 0
    rows = [(i, prose(40) + (" " + ("wrzgh" if part(i) == 3 and i % 2 else "vileword") if bad(i) else "") + " " + prose(10)) for i in range(600)]
    rows += [(1000 + i, prose(25) + " wrzgh " + prose(25)) for i in range(40)] + [(2000 + i, prose(50)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bad(i))) for i in range(600)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in score_toxicity(df, labels).collect()}
    assert sum(got[1000 + i] for i in range(40)) >= 36 and sum(got[2000 + i] for i in range(40)) <= 4


def test_decontamination(spark, empty):
    from tessera.llm.decontamination import contaminated, drop_contaminated

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    texts = [item, "x " + item.upper() + ", y", " ".join(w[10:] + ["mid"] + w[:10]), " ".join(w[:12]), "two words", "", None, "a short one", "b a short one c", " ".join(w[:4])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "a short one"), (3, None), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.tiles for r in contaminated(df, bench).collect()}
    assert got == {(0, 1): 1, (1, 1): 1, (2, 1): 2, (7, 2): 1, (8, 2): 1}
    assert {r.doc_id for r in drop_contaminated(df, bench).collect()} == {3, 4, 5, 6, 9}
    assert contaminated(empty, bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0


def test_repeats(spark, docs, empty):
    from tessera.llm.suffixes import digest_repeats

    first = {}
    order = lambda i: 1 << 62 if i is None else i
    for i, t in ROWS:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], 1 << 63), order(i))
    want = []
    for i, t in ROWS:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < order(i):
                gone[p : p + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want.append((key(i), len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in digest_repeats(docs).collect()) == sorted(want)
    assert digest_repeats(empty).count() == 0


def test_loser_tree():
    from tessera.llm.suffixes import loser_tree

    runs = [sorted(bytes(random.choice(b"ab") for _ in range(6)) for _ in range(n)) for n in (0, 7, 1, 20, 13)]
    shared = lambda a, b: next((k for k in range(6) if a[k] != b[k]), 6)
    got = list(loser_tree([(r, [0] + [shared(a, b) for a, b in zip(r, r[1:])]) for r in runs]))
    out = [runs[r][k] for r, k, _ in got]
    assert out == sorted(x for r in runs for x in r)
    assert [c for *_, c in got][1:] == [shared(a, b) for a, b in zip(out, out[1:])]


def test_warc(spark, tmp_path):
    from tessera.llm.warc import archive_pages, read_archive

    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 9000, "x\r\n\r\nWARC/1.1\r\ny", "<p>a</p>"]
    rows = [(10 - i, f"http://x/{i}" if i else None, h) for i, h in enumerate(html)]
    path = f"file://{tmp_path}/w"
    archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = {r.page_id: r for r in read_archive(spark, path, verify=True).collect()}
    for i, _, h in rows:
        b = (h or "").encode()
        least = min(j for j, _, g in rows if (g or "") == (h or ""))
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == least else ("revisit", least))
        assert i != least or bytes(r.payload) == b
    some = read_archive(spark, path, "page_id long, record_type string").filter("record_type = 'revisit'")
    assert "record_type" in some._jdf.queryExecution().executedPlan().toString() and some.count() == sum(r.record_type == "revisit" for r in got.values())
    archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert read_archive(spark, f"file://{tmp_path}/e").count() == 0


def test_components(spark):
    from tessera.llm.components import components

    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)] + [(200, 200 + k) for k in range(1, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[229] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, prose(60) + (" vileword" if i % 6 == 0 else "")) for i in range(300)] + [(500, prose(30) + " " + item), (501, "mail me at a@b.org " + BASE), (502, "mail me at a@b.org " + BASE)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    missed, lost = {i for i in got if i < 300 and i % 6 == 0}, {i for i in range(300) if i % 6} - got
    assert 501 in got and not {500, 502} & got
    assert len(missed) <= 2 and len(lost) <= 5, (missed, lost)
