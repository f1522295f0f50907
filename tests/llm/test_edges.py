"""Each operator and stage against brute force at its edges: nulls, empty and very long texts, ties, repeats, empty tables, clashing names, damage."""

import gzip
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tessera.llm")
import public_tokenizers
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
G = random.Random(11)
VOWELS, CONSONANTS = "aeiou", "bdfgklmnprst"


def word(n=3):
    return "".join(G.choice(CONSONANTS) + G.choice(VOWELS) for _ in range(n))


def prose(n):
    return " ".join(word(G.randrange(1, 4)) for _ in range(n))


def clashing(df, key="doc_id"):
    """The same rows with columns named as operators name theirs."""
    names = ["_text", "_TEXT2", "_key", "key", "_row", "_score", "_predicted", "_peak", "node", "root", "fp", "_id", "_hash", "spans", "terms", "a.b", "n", "shard", "rank", "_query", "payload", "record_type", "size"]
    return df.select("*", *[F.col(key).cast("string").alias(x) for x in names])


def test_shards_are_nearly_equal(spark):
    """The law ``bytes``: cuts are half a row from their equal targets at most."""
    from tessera.llm.sharding import shard_documents

    rows = [(i, prose(G.randrange(0, 30))) for i in range(1500)] + [(5, None)] * 40 + [(None, "x")] * 3
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = shard_documents(df, 8).collect()
    size = [0] * 8
    for r in got:
        size[r.shard] += r.size
    most, target = max(r.size for r in got), sum(size) / 8
    ends = np.cumsum(size)
    assert len(got) == len(rows) and all(abs(ends[k] - (k + 1) * target) <= most / 2 + 1 for k in range(8))
    lows = {s: [key for key in (r.doc_id for r in got if r.shard == s)] for s in range(8)}
    order = lambda x: -1 if x is None else x
    assert all(max(map(order, lows[k])) <= min(map(order, lows[k + 1])) for k in range(7))


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    from tessera.llm.tokens import Encoder

    library, ours = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY, 30_000, 10_000)
    texts = [x for i in range(0x320) for c in [chr(i)] for x in (c, c + "b", "a" + c, f"a {c} b", f"1{c}x", c + c)]
    texts += [prose(400), "x" * 50_000, "it's <|endoftext|> 12 " * 50, "漢字 ﬁ é", " \n\t"]
    for t in texts:
        assert np.frombuffer(ours.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:20])
    assert 0 < ours.words.size <= 30_000 and 0 < ours.pieces.size <= 10_000
    ours.forget()
    assert not ours.words.size and not ours.pieces.size and ours.ids(None) == b""


def _warc(kind, payload, **fields):
    block = payload if kind == "resource" else b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + payload
    head = {"WARC-Type": kind, "Content-Type": "text/html" if kind == "resource" else "application/http; msgtype=response", **fields, "content-length": len(block)}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """A gzip member for each record, one member for all, and a plain file, read alike."""
    from tessera.llm.warc import read_archive

    payloads = [b"a", b"", b"x\r\n\r\nWARC/1.0\r\n\r\ny" * 30_000, bytes(G.randrange(256) for _ in range(90_000))]
    records = [_warc("warcinfo", b"made by hand", **{"WARC-Target-URI": ""})] + [_warc("response", p, **{"WARC-Target-URI": f"http://h/{i}"}) for i, p in enumerate(payloads)] + [_warc("resource", b"as it is", **{"WARC-Target-URI": "http://h/r"})]
    files = {"a.warc.gz": b"".join(map(gzip.compress, records)), "b.warc.gz": gzip.compress(b"".join(records)), "c.warc": b"".join(records)}
    for name, data in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_bytes(data)
        path = f"file://{tmp_path}/{name}"
        got = {r.url: r for r in read_archive(spark, path, verify=True).filter("record_type = 'response'").collect()}
        assert {u: bytes(r.payload) for u, r in got.items()} == {f"http://h/{i}": p for i, p in enumerate(payloads)}
        assert all(r.payload_bytes == len(r.payload) and r.page_id is None for r in got.values())
        assert sorted(r.record_type for r in read_archive(spark, path, "record_type string").collect()) == ["resource"] + ["response"] * 4 + ["warcinfo"]
        assert bytes(read_archive(spark, path, "url string, payload binary").filter("url = 'http://h/r'").head().payload) == b"as it is"


def test_archive_edges(spark, tmp_path):
    """Clashing columns, repeated and null ids, and a payload that many pages share."""
    from tessera.llm import warc

    rows = [(i % 50, f"http://h/{i}", "<p>same</p>" if i % 3 else f"<p>{i}</p>") for i in range(120)] + [(None, None, "<p>same</p>"), (None, None, "alone"), (7, "u", None)]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), "page_id")
    order = lambda i: 1 << 62 if i is None else i
    want = []
    for i, _, h in rows:
        least = min((j for j, _, g in rows if (g or "") == (h or "")), key=order)
        want.append((order(i), len((h or "").encode()), "response" if i == least else "revisit", order(None if i == least else least)))
    for few in (200_000, 0):
        warc.FEW = few
        path = f"file://{tmp_path}/w{few}"
        warc.archive_pages(df, path)
        assert sorted((order(r.page_id), r.payload_bytes, r.record_type, order(r.refers_to)) for r in warc.read_archive(spark, path, verify=True).collect()) == sorted(want)
    warc.FEW = 200_000


def test_nearest_edges(spark):
    """Ties, repeated ids, clashing columns, and fewer candidates than asked for."""
    from tessera.llm.ann import nearest

    rows = [(i, [float(i % 4), 1.0]) for i in range(40)] + [(20, [9.0, 9.0]), (41, [3.0, 1.0]), (41, [3.0, 1.0]), (None, [1.0, 1.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id")
    got = nearest(df, F.col("vec_id") % 20 == 0, 60).collect()
    for q in (0, 20):
        x = min(v for i, v in rows if i == q)
        want = sorted(((-sum(a * b for a, b in zip(x, v)), i) for i, v in rows if i is not None and i != q))
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(-r.score, r.vec_id) for r in own] == want and [r["rank"] for r in own] == list(range(1, len(want) + 1))
    assert len(got) == 83


def test_recall(spark):
    """Recall at 20 on isotropic vectors, the hardest for planes, over several shards; and no row that wasn't offered is scored."""
    from tessera.llm.ann import nearest

    g = np.random.default_rng(4)
    x = g.standard_normal((4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = nearest(df, F.col("vec_id") % 20 == 0, 20, shard=1500).toPandas()
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -9)
    found = sum(len(set(np.argsort(-s[q])[:20]) & set(part["vec_id"])) for q, part in got.groupby("query_id"))
    assert len(got) == 4000 and found / 4000 >= 0.9


def test_private_edges(spark):
    """A text full of matches, clashing columns and repeats."""
    from tessera.llm.privacy import find_personal_data, sanitise

    many = " ".join(f"u{i}@x.org {i % 256}.1.2.3" for i in range(3000))
    rows = [(1, many), (2, None), (3, ""), (3, ""), (4, "call +1 234 567 8901 now"), (4, "call +1 234 567 8901 now"), (None, "b@c.de")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("n_chars", F.lit(-1))
    got = find_personal_data(df).collect()
    spans = {r.doc_id: r.spans for r in got}
    assert len(got) == 7 and [(r.n_email, r.n_ip) for r in got if r.doc_id == 1] == [(3000, 3000)]
    want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"u\d+@x.org", many)] + [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"\d+\.1\.2\.3", many)]
    assert spans[1] == ",".join(want) and spans[2] == "" and spans[None] == "email:0:6"
    out = sanitise(df)
    assert out.columns == df.columns
    texts = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "", r.n_chars, r["_key"], r["a.b"]) for r in out.collect())
    assert texts == [(-1, "[EMAIL]", 7, None, None), (1, " ".join(["[EMAIL] [IP]"] * 3000), 38_999, "1", "1"), (2, "", -1, "2", "2"), (3, "", -1, "3", "3"), (3, "", -1, "3", "3"), (4, "call [PHONE] now", 16, "4", "4"), (4, "call [PHONE] now", 16, "4", "4")]


def test_thresholds_are_arguments(spark):
    from tessera.llm.privacy import Disclosure, find_personal_data

    rows = [(i, f"{prose(3)} kontakt u{i}@x.org") for i in range(40)] + [(100 + i, prose(6)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    flagged = lambda limits: "term" in {r.doc_id: r.spans for r in find_personal_data(df, limits).collect()}[1]
    assert flagged(Disclosure()) and not flagged(Disclosure(bits=60.0)) and not flagged(Disclosure(near=0))


def brute_logs(train, texts):
    """Both classes' log-likelihoods of each text by the formulas, with dictionaries of units."""
    from tessera.llm.toxicity import DISCOUNT, ORDER, PLAIN, words

    def sequences(w):
        units = [1]
        for c in w:
            units += [ord(c)] if ord(c) < PLAIN else [("high", ord(c) >> 11), ("low", ord(c) & 2047)]
        units.append(2)
        return [tuple(units[max(0, k - ORDER + 1) : k + 1]) for k in range(1, len(units))]

    pad = lambda s, k: ((0,) * k + s)[-k:]
    counts = [Counter(), Counter()]
    for text, label in train:
        for w in words(text):
            counts[label].update(pad(s, ORDER) for s in sequences(w))
    both = counts[0] + counts[1]
    levels, seen = {}, set(both)
    for k in range(ORDER - 1, 0, -1):
        levels[k] = Counter(s[1:] for s in seen)
        seen = set(levels[k])

    def weights(table):
        total, kinds = Counter(), Counter()
        for s, n in table.items():
            total[s[:-1]] += n
            kinds[s[:-1]] += 1
        return total, {c: DISCOUNT * kinds[c] / total[c] for c in total}

    floor = 1 / (sum(levels[1].values()) + len(levels[1]) + 1)
    by_level = {k: weights(levels[k]) for k in range(2, ORDER)}

    def shared(s):
        if len(s) == 1:
            return (levels[1][s] + 1) * floor if s in levels[1] else floor
        total, back = by_level[len(s)]
        low = shared(s[1:])
        return (levels[len(s)][s] - DISCOUNT) / total[s[:-1]] + back[s[:-1]] * low if s in levels[len(s)] else back.get(s[:-1], 1.0) * low

    tops, pooled = [weights(c) for c in counts], weights(both)[1]

    def p(s, label):
        low = shared(s[1:])
        if s not in both:
            return pooled.get(s[:-1], 1.0) * low
        total, back = tops[label]
        return max(counts[label][s] - DISCOUNT, 0) / max(total[s[:-1]], 1) + back.get(s[:-1], 1.0) * low

    out = []
    for text in texts:
        all_ = [pad(s, ORDER) for w in words(text) for s in sequences(w)]
        out.append([sum(math.log(p(s, label)) for s in all_) / max(len(all_), 1) for label in (1, 0)])
    return out


def test_likelihoods_are_kneser_neys(spark, monkeypatch):
    """Both paths against the formulas, with unseen words, wide characters, long words, repeats, nulls and clashing columns."""
    from tessera.llm import toxicity

    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    rows = [(i, prose(12) + (f" {G.choice(['vileword', 'übelst', '漢字罵'])} " if i % 4 == 0 else " ") + prose(5)) for i in range(160)]
    rows += [(900, "zzzqqq unseen 🜁🜂 words"), (901, "y" * 30_000), (902, None), (903, ""), (5, prose(9)), (5, prose(9)), (None, "no id vileword")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    train = [(t, int(i % 4 == 0)) for i, t in rows if i is not None and i < 160 and fold(i) != 2]
    want = brute_logs(train, [t for _, t in rows])
    for most in (1_000_000, 20):
        monkeypatch.setattr(toxicity, "GRAMS", most)
        got = toxicity.score_toxicity(df, labels).collect()
        order = lambda x: (-1 if x[0] is None else x[0], round(x[1], 6), round(x[2], 6))
        mine = sorted(((r.doc_id, r.toxic_ll, r.other_ll) for r in got), key=order)
        brute = sorted(((i, *w) for (i, _), w in zip(rows, want)), key=order)
        assert [a[0] for a in mine] == [b[0] for b in brute] and np.allclose([a[1:] for a in mine], [b[1:] for b in brute], atol=1e-9)
        assert all(0 <= r.score <= 1 for r in got)
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and all(r["_text"] == (None if r.doc_id is None else str(r.doc_id)) for r in kept.collect())


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    from tessera.llm.token_store import write_store

    rows = [(i, prose(G.randrange(1, 900))) for i in range(40)] + [(50 + i, "") for i in range(30)] + [(9, None)]
    path = f"{tmp_path_factory.mktemp('store')}/s"
    root = write_store(clashing(spark.createDataFrame(rows, "doc_id long, text string")), f"file://{path}", VOCABULARY, 3)
    return path, root, len(rows)


def _copy(path, tmp_path):
    import shutil

    return shutil.copytree(path, tmp_path / "s", dirs_exist_ok=True)


def _rewrite(spark, folder, change):
    df = change(spark.read.parquet(f"file://{folder}"))
    df.write.mode("overwrite").parquet(f"file://{folder}-new")
    import shutil

    shutil.rmtree(folder)
    shutil.move(f"{folder}-new", folder)


def test_store_reads_back(spark, store):
    from tessera.llm.token_store import read_ids, read_summary

    path, root, n = store
    assert read_summary(spark, f"file://{path}", root).count() == n == read_ids(spark, f"file://{path}", root).count()


@pytest.mark.parametrize("damage", ["lost recipe", "doubled recipe", "changed recipe", "lost chunk", "changed chunk", "lost node", "wrong root"])
def test_damage_is_found(spark, store, tmp_path, damage):
    from tessera.llm.token_store import read_ids, read_summary

    path, root, _ = store
    copy = _copy(path, tmp_path)
    if damage == "lost recipe":
        _rewrite(spark, f"{copy}/recipes", lambda d: d.filter("doc_id <> 7"))
    elif damage == "doubled recipe":
        _rewrite(spark, f"{copy}/recipes", lambda d: d.union(d.filter("doc_id = 7")))
    elif damage == "changed recipe":
        _rewrite(spark, f"{copy}/recipes", lambda d: d.withColumn("doc_id", F.when(F.col("doc_id") == 7, 8).otherwise(F.col("doc_id"))))
    elif damage == "lost chunk":
        one = spark.read.parquet(f"file://{copy}/blocks").filter("octet_length(digest) = 16").orderBy("digest").first().digest
        _rewrite(spark, f"{copy}/blocks", lambda d: d.filter(F.col("digest") != F.lit(one)))
    elif damage == "changed chunk":
        _rewrite(spark, f"{copy}/blocks", lambda d: d.withColumn("payload", F.when(F.octet_length("payload") > 9, F.concat(F.substring("payload", 1, 5).cast("binary"), F.unhex(F.lit("0100")), F.expr("substring(payload, 8)"))).otherwise(F.col("payload"))))
    elif damage == "lost node":
        _rewrite(spark, f"{copy}/manifest", lambda d: d.filter("nth < 0"))
    else:
        root = "0" * 64
    for read in (read_summary, read_ids):
        with pytest.raises(Exception, match="differ|missing|root"):
            read(spark, f"file://{copy}", root).collect()


def brute_tiles(doc, item, width):
    marked_doc, marked_item, out = [0] * len(doc), [0] * len(item), []
    while True:
        best = None
        for b, a in itertools.product(range(len(item)), range(len(doc))):
            n = 0
            while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and not marked_doc[a + n] and not marked_item[b + n]:
                n += 1
            if n >= width and (best is None or (-n, b, a) < best):
                best = (-n, b, a)
        if best is None:
            return out
        n, b, a = -best[0], best[1], best[2]
        out.append((a, b, n))
        marked_doc[a : a + n] = marked_item[b : b + n] = [1] * n


def test_tiles_are_greedy(spark):
    """Both ways to tile, and the operator over several blocks, against brute force."""
    from tessera.llm.decontamination import Items, contaminated, drop_contaminated, maximal, tile, tile_by_passes, words

    items = [" ".join(G.choice(v) for _ in range(G.randrange(1, 22))) for v in ("ab", "abc", "abcdefgh") * 8] + [None, ""]
    docs = [" ".join(G.choice(v + "x") for _ in range(G.randrange(1, 50))) for v in ("ab", "abcd", "abcdefgh") * 10] + [None, "", "!?"]
    block = Items([(k, t) for k, t in enumerate(items) if t], 3)
    want = set()
    for d, text in enumerate(docs):
        ids = np.array([block.known.get(w, 0) for w in words(text)], dtype=np.uint64)
        for k, own in block.items:
            tiles = brute_tiles(words(text), words(items[k]), min(3, len(own)))
            n = sum(t[2] for t in tiles)
            if n >= 0.7 * len(own):
                want.add((d, k, n, len(tiles), max(t[2] for t in tiles)))
        for k, width, runs in block.shared(ids, 0.1):
            own = block.items[k][1]
            assert tile(*maximal(ids, own, width, runs, 10**9), width, len(ids), len(own)) == tile_by_passes(ids, own, width) == brute_tiles(ids.tolist(), own.tolist(), width)
    rows = [(d, t) for d, t in enumerate(docs)] + [(None, docs[0]), (0, docs[0])]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = clashing(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), "item_id")
    for size in (8_000_000, 60):
        got = contaminated(df, bench, 3, 0.7, size).collect()
        assert {(r.doc_id, r.item_id, r.covered, r.tiles, r.longest) for r in got if r.doc_id is not None} == want
        assert len(got) == len(want) + 2 * sum(d == 0 for d, *_ in want)
        kept = drop_contaminated(df, bench, 3, 0.7, size)
        bad = {d for d, *_ in want}
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(docs))) - bad)


def test_repetitive_texts_take_little(spark):
    """One word thousands of times, and too many maximal matches to hold."""
    from tessera.llm import decontamination as D

    one = D.Items([(1, "a " * 2000)], 5)
    ids = np.ones(8000, dtype=np.uint64)
    (_, width, runs), = one.shared(ids, 0.8)
    found = D.maximal(ids, one.items[0][1], width, runs, D.MOST)
    assert len(found[0]) == 9991 and D.tile(*found, width, 8000, 2000) == [(0, 0, 2000)]
    df = spark.createDataFrame([(1, "p q r s t u " * 400), (2, " ".join(f"p q r s t u z{i}" for i in range(3000)))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(f"p q r s t u y{i}" for i in range(150)))], "item_id long, text string")
    assert D.maximal(*_case(D, df, bench), D.MOST) is None
    got = {r.doc_id: (r.covered, r.tiles, r.longest) for r in D.contaminated(df, bench).collect()}
    assert got == {1: (900, 150, 6), 2: (900, 150, 6)}


def _case(D, df, bench):
    block = D.Items([(1, bench.head().text)], 5)
    ids = np.array([block.known.get(w, 0) for w in D.words(df.filter("doc_id = 2").head().text)], dtype=np.uint64)
    (k, width, runs), = block.shared(ids, 0.8)
    return ids, block.items[k][1], width, runs


def brute_removed(rows):
    first, order = {}, lambda i: 1 << 62 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], 1 << 63), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < order(i):
                gone[p : p + 50] = True
        out.append((order(i), len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


def _removed(df, **options):
    from tessera.llm.suffixes import remove_repeats

    return sorted((1 << 62 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(df, **options).collect())


def test_a_least_hash_of_zero_is_an_anchor(spark):
    text = "abcde fghij klmxoyqfsjpfleudznpshle opqrs tuvwxyz."
    rows = [(1, text), (2, text), (3, "x" + text[1:] + "y")]
    assert _removed(spark.createDataFrame(rows, "doc_id long, text string")) == brute_removed(rows)


def test_hot_sequences(spark):
    """A passage in every document with other neighbours each time, hot or not; long documents, repeats and null ids."""
    passage, line = prose(6)[:44], "all rights are reserved by whoever wrote this line of text here. "
    rows = [(i, f"{prose(8)} {passage} {prose(8)}") for i in range(150)] + [(i, line + prose(5) + line) for i in range(150, 200)]
    rows += [(3, line * 3), (None, f"{passage} {line}"), (None, line), (300, prose(4000) + line), (301, None), (302, ""), (303, "z" * 9000), (304, "z" * 500), (305, "\0" * 120), (306, "\0" * 130)]
    G.shuffle(rows)
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    want = brute_removed(rows)
    for hot in (100_000, 20, 0):
        assert _removed(df, hot=hot) == want


def test_hashes_alone_decide_nothing(monkeypatch):
    """Contexts and strings whose hashes collide are told apart by their bytes."""
    from tessera.llm import suffixes as S

    g = np.random.default_rng(2)
    rows = g.integers(97, 99, (300, S.WIDE), dtype=np.uint8)
    rows[:, -2:] = S.REACH
    rows[:, :70] = rows[0, :70]
    rows[150:] = rows[:150]
    group, least = np.arange(300) % 3, g.integers(0, 50, 300)
    first, same = S._distinct(rows)
    want = S.repeated(rows, group, least)
    assert len(first) == len({r.tobytes() for r in rows}) and all((rows[first[same]] == rows).all(1))
    monkeypatch.setattr(S, "_name", lambda x: np.zeros(len(x), dtype=np.uint64))
    first, same = S._distinct(rows)
    assert len(first) == len({r.tobytes() for r in rows}) and all((rows[first[same]] == rows).all(1))
    monkeypatch.setattr(S, "_BASE", 1)
    assert (S.repeated(rows, group, least) == want).all()


def test_simhash_edges(spark):
    """Clashing columns and a large group of copies."""
    from tessera.llm.simhash import drop_near_duplicates, near_duplicates

    same = prose(40)
    rows = [(i, same) for i in range(60)] + [(100 + i, prose(40)) for i in range(20)] + [(None, same), (300, None), (301, "a b"), (7, same)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = near_duplicates(df).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id is not None and r.doc_id < 60} == {0}
    out = drop_near_duplicates(df)
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == df.columns and sorted(kept) == [0] + [100 + i for i in range(20)] + [300, 301]


def test_bands_hold_all_pairs():
    """Pairs within the radius of a band are found, however leaves are compared."""
    from tessera.llm.simhash import Forest, _banded, _dense, _flips

    g = np.random.default_rng(3)
    x = g.integers(0, 1 << 12, 3000, dtype=np.uint64) | (g.integers(0, 1 << 10, 3000, dtype=np.uint64) << np.uint64(30))
    mask, left, right = np.uint64(0xFFF), np.arange(0, 2000), np.arange(1000, 3000)
    near = lambda a, b: np.bitwise_count((x[a] ^ x[b]) & mask) <= 1
    for l, r in ((left, right), (left, left)):
        want = {(min(p, q), max(p, q)) for p, q in zip(*[np.concatenate(c) for c in zip(*_dense(x, l, r, 4))]) if near(p, q)}
        got = {(min(p, q), max(p, q)) for part in _banded(x, l, r, mask, _flips(mask, 1), 4) for p, q in zip(*part)}
        assert got == want
    assert Forest(3).links == []


def test_spread_join(spark, monkeypatch):
    from tessera.llm import skew

    monkeypatch.setattr(skew, "LEAST", 10)
    rows = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(4000)] + [(None, 0)], "k long, v long")
    one = spark.createDataFrame([(i, -i) for i in range(0, 4000, 2)] + [(1, 5)], "k long, w long")
    got = skew.spread_join(rows, one, "k")
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.select("v", "w").collect())) == sorted((i, 5 if i % 2 else -i) for i in range(4000))


def test_written_tables(spark):
    """Folders get their scheme; a table goes when it is forgotten."""
    import os

    from tessera.llm import scratch

    assert scratch._qualified(spark, "/tmp/x") == "file:///tmp/x" == scratch._qualified(spark, "file:/tmp/x") and scratch._qualified(spark, "s3a://b/x") == "s3a://b/x"
    one = scratch.materialise(spark.range(3).select(F.col("id").alias("a.b")), "one")
    folder = one._written.removeprefix("file://")
    assert sorted(r[0] for r in one.collect()) == [0, 1, 2] and os.path.isdir(folder)
    scratch.forget(one, spark.range(1))
    assert not os.path.exists(folder)


def test_even_keys(spark):
    from tessera.llm.skew import even_keys

    for n in (1, 3, 8, 50):
        keys = even_keys(spark, n)
        counts = spark.createDataFrame([(k,) for k in keys], "k long").groupBy(F.pmod(F.hash("k"), F.lit(4)).alias("p")).count().collect()
        assert len(set(keys)) == n and max(r["count"] for r in counts) == -(-n // 4)


def _pipeline_folder(spark, tmp_path, rows, labels, items):
    clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).drop("a.b").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_at_their_edges(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeats and clashing columns pass every stage; so do empty tables."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, prose(30) + (" vileword" if i % 5 == 0 else ""), "en", "s", 1) for i in range(120)]
    rows += [(None, prose(20), None, None, None), (200, None, "en", "s", 0), (201, "", None, "s", None), (202, " ".join(rows[i][1] for i in range(120) if i % 5) * 3, "en", None, 1), (203, prose(12), "en", "s", 1), (203, prose(12), "en", "s", 1)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(120)] + [(None, None, None), (1, 1, None)]
    (tmp_path / "full").mkdir()
    folder = _pipeline_folder(spark, tmp_path / "full", rows, labels, [(1, "one two three four five six"), (2, None), (None, "")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns, name
    kept = Counter(r.doc_id for r in docs.collect())
    assert kept[None] == 1 and kept[202] == 1 and kept[203] == 2 and kept[200] + kept[201] == 1
    assert {r.doc_id for r in pipeline.run(spark, folder).collect()} == set(kept)
    (tmp_path / "empty").mkdir()
    folder = _pipeline_folder(spark, tmp_path / "empty", rows[:0], labels[:0], [])
    assert pipeline.run(spark, folder).count() == 0


def test_words_seen_once_leave_those_seen_again():
    from tessera.llm.tokens import Cache

    cache = Cache(100_000)
    cache.keep("often", b"1234")
    assert cache.find("often") == b"1234"
    for k in range(5_000):
        assert cache.find(f"w{k}") is None
        cache.keep(f"w{k}", b"5678")
        assert cache.size <= 100_000
    assert cache.find("often") == b"1234" and cache.find("w0") is None and cache.find("w4999") == b"5678"


def test_many_texts_look_up_each_piece_once(monkeypatch):
    from tokenizers import Tokenizer

    from tessera.llm.tokens import _PIECE, Cache, Encoder

    own, library, ours = random.Random(5), Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)
    signs = [chr(i) for i in range(0x310)] + list("'''stmdrevell 09²\x0b\xa0\x85K") * 30
    texts = ["".join(own.choice(signs) for _ in range(own.randrange(60))) for _ in range(4_000)]
    texts += [None, "", " ", "'", "x'", "it'", "we'll", "'re", "a\n'r", "<|endoftext|> b", "漢字", "'s's", "²2"]
    own.shuffle(texts)
    for size in (1, 300):
        for k in range(0, len(texts), size):
            for text, ids in zip(texts[k : k + size], ours.many(texts[k : k + size])):
                assert ids.tolist() == (library.encode(text, add_special_tokens=False).ids if text else []), repr(text)
    asked = Counter()
    find = Cache.find
    monkeypatch.setattr(Cache, "find", lambda self, key: asked.update([(id(self), key)]) or find(self, key))
    texts = ["Some words, then words' ends; some more words: 12."] * 500
    got = Encoder(VOCABULARY).many(texts)
    assert max(asked.values()) == 1 and {key for _, key in asked} == set(_PIECE.findall(texts[0].lower()))
    assert {x.tobytes() for x in got} == {ours.ids(texts[0])}


def test_a_store_is_the_same_in_blocks_of_any_size(monkeypatch):
    import pyarrow as pa

    from tessera.llm import token_store as T

    own = random.Random(6)
    texts = [" ".join(own.choice(["spring", "autumn,", "Übung", "it's", "漢"]) for _ in range(own.randrange(1_500))) for _ in range(30)] + [None, "", "x " * 700_000]
    batch = pa.RecordBatch.from_arrays([pa.array([*range(len(texts) - 1), None], pa.int64()), pa.array(texts)], names=["doc_id", "text"])

    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(T, "TaskContext", Context)
    found = []
    for size in (0, 9_000, T.AT_ONCE):
        monkeypatch.setattr(T, "AT_ONCE", size)
        found.append([r for b in T._encoder(VOCABULARY)([batch]) for r in b.to_pylist()])
    assert found[0] == found[1] == found[2]
    recipes = [r for r in found[0] if r["payload"] is None]
    ours = T.Encoder(VOCABULARY)
    assert [(r["doc_id"], r["n_tokens"]) for r in recipes] == [(d, len(ours.ids(t)) // 4 + 1) for d, t in zip(batch.column(0).to_pylist(), texts)]
