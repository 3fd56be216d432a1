"""Corpus operators against brute force, the tokenizers library, round trips and odd tables."""

import base64
import collections
import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm import bpe, chat, decontaminate, hmm, ordinal, parity, rules, secrets, sstable, warc, words
from weftline.llm.files import read_manifest
from weftline.llm.shared import bounded_slices, shared_dir
from weftline.llm.tokenizer_files import tokenizer_path

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = ["", " ", "\n\n\t x", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "\x00\x1c\x1d\x85 x  y", "a'll 'LL've I'm", "日本語テキスト😀👩‍👩‍👧", "x" * 9000, " " * 3000 + "a", "=-" * 999, "١٢٣ ½ ²", "ΣΑΣ İstanbul", "a b c　　d e", "é́ ́x"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def noise(n, seed, letters="abcde t's\n.,é "):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(1, 80))) for _ in range(n)]


def prose(r, n):
    return [r.choice(["the", "of", "and"]) if r.random() < 0.4 else "".join(r.choice(["th", "er", "in", "on", "ed", "an"]) for _ in range(r.randrange(1, 5))) for _ in range(n)]


def table(spark, texts, extra=()):
    rows = [(i, t) for i, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def brute_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


# ---- tokenizers


def test_bpe_equals_library():
    b, t = bpe.TrieBpe(open(BYTES, encoding="utf-8").read()), Tokenizer.from_file(BYTES)
    held = ODD + noise(400, 1) + noise(300, 2, [chr(c) for c in range(1, 0x3100, 7)])
    for text, got, want in zip(held, b.encode_batch(pa.array(held)), t.encode_batch(held, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text[:60]
        assert b.decode(got) == t.decode(want.ids, skip_special_tokens=False)


def test_bpe_tables(spark):
    df = table(spark, ["the cat", None, "", "the cat"]).withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r.doc_id: r for r in bpe.bpe_encode(df, BYTES).collect()}
    assert got[1].ids == [] and got[0].ids == got[3].ids and got[0].n_tokens == len(got[0].ids)
    back = {r.doc_id: r.text for r in bpe.bpe_decode(bpe.bpe_encode(df, BYTES), BYTES).collect()}
    assert back == {0: "the cat", 1: "", 2: "", 3: "the cat"}
    assert bpe.bpe_digests(df.limit(0), BYTES).count() == 0
    d = {r.doc_id: r for r in bpe.bpe_digests(df, BYTES).collect()}
    assert d[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and d[0].decoded_sha256 == hashlib.sha256(b"the cat").hexdigest()


def test_shards_equal_library_and_look_up(spark):
    held = ODD + noise(300, 3) + noise(100, 4, [chr(c) for c in range(0x21, 0x3100, 5)])
    df = table(spark, held, [(None, "x y"), (5, "twice"), (-3, "below"), (900, None)])
    folder = shared_dir(spark, "test")
    sstable.write_shards(df, folder, WORDS, shard_bytes=3000)
    t, start = Tokenizer.from_file(WORDS), 0
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    got = sorted(sstable.read_shards(spark, folder).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and len(read_manifest(folder)) > 2
    for r, g in zip(rows, got, strict=True):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sstable.lookup(folder, 3).tolist() == t.encode(held[3], add_special_tokens=False).ids + [2]
    assert sstable.lookup(folder, 10**9) is None and sstable.lookup(folder, -3) is not None
    empty = shared_dir(spark, "test")
    assert sstable.write_shards(df.limit(0), empty, WORDS) == [] and sstable.read_shards(spark, empty).count() == 0


# ---- archives


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u 4", ""), (5, "u", "héé"), (9, "v", "same"), (9, "w", "same"), (None, "n", "héé")], "page_id long, url string, html string")
    folder = shared_dir(spark, "test")
    warc.write_warc(df.withColumn("payload", F.lit(1)), folder, file_bytes=200)
    assert len(read_manifest(folder)) > 1
    rows = sorted(warc.read_warc(spark, folder).collect(), key=lambda r: (r.page_id is not None, r.page_id or 0, r.record_type))
    told = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows]
    assert told == [(None, 5, "revisit", 5), (1, 4, "revisit", 9), (2, 4, "revisit", 9), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 5, "response", None), (9, 4, "response", None), (9, 4, "revisit", 9)]
    assert rows[5].payload_digest == base64.b32encode(hashlib.sha1("héé".encode()).digest()).decode()
    again = shared_dir(spark, "test")
    assert [x["sha256"] for x in warc.write_warc(df, again, file_bytes=200)] == [x["sha256"] for x in read_manifest(folder)]
    none = shared_dir(spark, "test")
    assert warc.write_warc(df.limit(0), none) == [] and warc.read_warc(spark, none).count() == 0
    least = shared_dir(spark, "test")
    warc.write_warc(df, least, min_payload=5)
    assert {r.page_id: r.record_type for r in warc.read_warc(spark, least).collect()}[1] == "response"


def test_warc_is_the_same_however_the_table_lies(spark):
    """Two writes of a table in other orders and partitions give equal bytes; a null key and a hot key with many payloads are spread."""
    r = random.Random(8)
    rows = [(i if i % 3 else None, f"u{i}", " ".join(prose(r, 5)) + str(i % 900)) for i in range(3000)] + [(7, f"v{i}", f"p{i}") for i in range(1500)]
    seen = []
    for seed, partitions, shuffled in ((1, 1, "3"), (2, 9, "7")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        mixed = list(rows)
        random.Random(seed).shuffle(mixed)
        folder = shared_dir(spark, "test")
        told = warc.write_warc(spark.createDataFrame(mixed, "page_id long, url string, html string").repartition(partitions), folder, file_bytes=20_000, part_rows=250)
        seen.append([(x["part"], x["nth"], x["records"], x["sha256"]) for x in told])
        back = warc.read_warc(spark, folder)
        assert sorted((x.page_id or -1, x.url, x.payload_bytes) for x in back.collect()) == sorted((k or -1, u, len(h)) for k, u, h in rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] and sum(x[2] for x in seen[0]) == 4500
    by_part = collections.Counter()
    for part, _, n, _ in seen[0]:
        by_part[part] += n
    assert len(by_part) == 18 and max(by_part.values()) < 800


def test_warc_urls_come_back_as_they_were(spark):
    urls = ["http://a/b c", " http://x ", "a\r\nX: y", "http://ok/", "\t", ""]
    folder = shared_dir(spark, "test")
    warc.write_warc(spark.createDataFrame([(i, u, f"h{i}") for i, u in enumerate(urls)], "page_id long, url string, html string"), folder)
    assert [r.url for r in warc.read_warc(spark, folder).orderBy("page_id").collect()] == urls


# ---- chat


def test_escapes_can_be_undone():
    t = chat.Template()
    e, pieces = chat.Escape(t.controls), [*t.controls, "\\", "<", "[", "|", "x", "\\\\", "<\\|turn|>", "[\\INST]"]
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(7)))
        assert e.take(e.put(text)) == text and not any(c in e.put(text) for c in t.controls)
    with pytest.raises(ValueError):
        chat.Escape(("ab", "ba"))


def test_chat_reads_back(spark):
    r = random.Random(1)
    pieces = [*chat.Template().controls, "hé ", "\\", "<|turn|>assistant<|says|>", "😀"]
    rows = [(c, t, r.choice(["user", "assistant", None, "a<|says|>"]), None if r.random() < 0.1 else "".join(r.choice(pieces) for _ in range(r.randrange(5)))) for c in [None, *range(40)] for t in [0, 1, 1, None]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {x.conv_id: x for x in chat.chat_digests(chat.format_turns(df)).collect()}
    f = chat.Formatter(chat.Template())
    groups = collections.defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((-1 if t is None else t, f.segment(role, [{"type": "text", "text": text}])["formatted"], role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        learnt = "".join(x[3] for x in turns if x[2] == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(learnt))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.chat_digests(chat.format_turns(df.limit(0))).count() == 0


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b.wav", "seconds": 2.0}, {"type": "document", "ref": "c.pdf", "pages": 2}, None]
    s = chat.Formatter(chat.Template()).segment("user", parts)
    assert s["formatted"] == "<|turn|>user<|says|>see <|image|><|audio|><|document|></s>"
    assert [(a["type"], a["ref"], a["tokens"]) for a in s["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 50), ("document", "c.pdf", 1024)]
    assert all(s["formatted"][a["place"] :].startswith(f"<|{a['type']}|>") for a in s["attachments"])
    with pytest.raises(ValueError):
        chat.Formatter(chat.Template()).segment("user", [{"type": "smell"}])
    schema = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>>"
    full = lambda p: p and {k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")}
    df = spark.createDataFrame([(1, 0, "user", [full(p) for p in parts]), (1, 1, "assistant", [full({"type": "text", "text": "ok"})]), (1, 2, "user", None)], schema)
    rows = chat.assemble(chat.format_turns(df, parts="parts"), most_chars=60).orderBy("part").collect()
    whole = "".join(r.formatted for r in rows)
    assert len(rows) == 2 and whole.endswith("<|turn|>assistant<|says|>ok</s><|turn|>user<|says|></s>") and sum(r.attachment_tokens for r in rows) == 1078
    spans = [r.formatted[a:b] for r in rows for a, b in r.loss_spans]
    assert spans == ["ok"]


# ---- words, near duplicates, decontamination


def test_words_and_shingles():
    held = [*ODD, None, "A b\x0bC\x0c d\re F", "one two", *noise(50, 7)]
    batch = pa.RecordBatch.from_pydict({"t": held})
    names: dict[int, bytes] = {}
    for part in bounded_slices(batch, "t", 500):
        w = words.words_of(part.column(0))
        for i, text in enumerate(part.column(0).to_pylist()):
            own = w.hashes[w.ends_of[i] : w.ends_of[i + 1]]
            want = brute_words(text)
            assert len(own) == len(want)
            assert all(names.setdefault(int(h), x) == x for h, x in zip(own, want, strict=True))
            n = len(words.shingle_sets(words.words_of(pa.array([text], pa.string())))[0])
            assert n == (len({tuple(want[k : k + 5]) for k in range(len(want) - 4)}) if len(want) > 4 else min(1, len(want)))
    assert len(set(names.values())) == len(names)


def brute_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = brute_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(3)
    texts = []
    for n in (3, 4, 5, 6, 8, 12, 20, 40, 90, 200):
        base = prose(r, n)
        common = prose(r, 30)
        for k in range(12):
            w = list(base)
            for _ in range(k // 2):
                w[r.randrange(len(w))] = "edit" + str(r.randrange(99))
            texts.append(" ".join(w))
            texts.append(" ".join(prose(r, max(4, n // 3)) + common))
    texts += [None, "", " \n", "The THE", "the the", texts[5].upper()]
    df = table(spark, texts, [(None, "a b c d e f"), (2, texts[2])]).withColumn("sid", F.lit("clash"))
    got = parity.near_duplicates(df).collect()
    want = brute_components(list(enumerate(texts)))
    assert len(got) == len(texts) + 2
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None
        else:
            assert (x.n_shingles, x.component_id) == want[x.doc_id], x.doc_id
    kept = {x.doc_id for x in parity.keep_one_of_each(df).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c} | {None}
    assert parity.near_duplicates(df.limit(0)).count() == 0


def test_linked_sets_always_show_a_common_block():
    r, common = np.random.default_rng(0), np.zeros(1 << parity.COMMON_BITS, bool)
    for n in (1, 2, 4, 7, 8, 9, 15, 16, 31, 60, 127, 128, 300):
        for _ in range(40):
            a = r.integers(0, 1 << 63, n, dtype=np.uint64)
            d = int(r.integers(0, n // 4 + 1))
            b = np.concatenate([a[: n - d], r.integers(0, 1 << 63, int(r.integers(0, n // 4 + 1)), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            same = len(np.intersect1d(a, b))
            if same and 100 * same >= 80 * (len(a) + len(b) - same):
                owner, blocks = parity.shown([a, b], common)
                assert np.intersect1d(blocks[owner == 0], blocks[owner == 1]).size
                assert np.bitwise_count(parity.folded(parity.sketch(a), 64) ^ parity.folded(parity.sketch(b), 64)).sum() <= len(a) + len(b) - 2 * same


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 13, 16, 20, 31, 40, 64, 100])
def test_unrelated_sets_share_no_block(n):
    """No block is shared for being empty: of 10,000 unrelated sets of one size no two show the same."""
    g = np.random.default_rng(n)
    sets = [np.sort(x) for x in g.integers(0, 2**64, (10_000, n), dtype=np.uint64)]
    owner, blocks = parity.shown(sets, np.zeros(1 << parity.COMMON_BITS, bool))
    assert len(np.unique(owner)) == 10_000
    assert np.unique(blocks, return_counts=True)[1].max() == 1


def test_decontamination_equals_brute_force(spark):
    r = random.Random(9)
    items = [" ".join(prose(r, n)) for n in (3, 5, 9, 14, 20, 33, 50)] + [None, "", " ".join(["so so so so so so"])]
    docs = [None, "", "x"]
    for text in items:
        w = (text or "a b").split()
        for cut in range(4):
            docs.append(" ".join(prose(r, r.randrange(30)) + w[cut // 2 : len(w) - cut // 2] + prose(r, r.randrange(30))).upper())
        docs.append(" ".join(w[: max(1, len(w) // 2)] + prose(r, 20)))
        docs.append(" ".join(w[1:]))
    d, b = table(spark, docs, [(None, items[4])]), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for i, t in enumerate(docs):
        w = brute_words(t)
        for k, item in enumerate(items):
            v = brute_words(item)
            size = min(5, len(v))
            grams = lambda x, size=size: collections.Counter(tuple(x[j : j + size]) for j in range(len(x) - size + 1))
            if not v or not w:
                continue
            best = max(sum((grams(w[j : j + len(v)]) & grams(v)).values()) / len(range(len(v) - size + 1)) for j in range(max(1, len(w) - len(v) + 1)))
            if best >= 0.8:
                want[i, k] = best
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.find_benchmark(d, b).collect()}
    assert got.pop((None, 4)) == 1.0
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    clean = {x.doc_id for x in decontaminate.drop_contaminated(d, b).collect()}
    assert clean == set(range(len(docs))) - {i for i, _ in want}
    assert decontaminate.find_benchmark(d, b.limit(0)).count() == 0 and decontaminate.find_benchmark(d.limit(0), b).count() == 0


def test_decontamination_finds_items_cut_at_an_end():
    """Windows that keep exactly 0.8 of an item's shingles, or one less, however far their fingerprints lie."""
    r = random.Random(12)
    for n in (19, 24, 39, 54, 59):
        items = [prose(r, n) for _ in range(40)]
        index, lost = decontaminate.Index([" ".join(w) for w in items]), (n - 4) // 5
        for gone, want in ((lost, [(i, i, 0.8) for i in range(40)]), (lost + 1, [])):
            for front in (False, True):
                other = [f"other{r.random()}" for _ in range(gone)]
                docs = [" ".join(other + w[gone:] if front else w[: n - gone] + other) for w in items]
                assert sorted(x[:3] for x in index.search(words.words_of(pa.array(docs)))) == want


@pytest.mark.parametrize("n", [9, 15, 20, 30, 40, 50, 80, 120, 200])
def test_radius_covers_the_threshold(n):
    """Of windows that keep a contiguous 0.8 of an item's shingles, all lie within the radius; of unrelated ones, few do."""
    g = np.random.default_rng(n)
    places = n - 4
    lost = places - -(-80 * places // 100)
    a = g.integers(0, 2**63, (2000, places)).astype(words.U)
    b = a.copy()
    b[:, places - lost :] = g.integers(0, 2**63, (2000, lost)).astype(words.U)
    x, y = (decontaminate.fingerprints(decontaminate.elements(m)) for m in (a, b))
    assert (decontaminate.distances(x, y) <= decontaminate.RADIUS).all()
    assert (decontaminate.distances(x, np.roll(y, 1, axis=0)) <= decontaminate.RADIUS).mean() < 0.02


def test_blocks_name_every_fingerprint_within_the_radius():
    g = np.random.default_rng(3)
    items = g.integers(0, 2**63, (300, 12)).astype(words.U)
    size = decontaminate.SizeIndex(16, np.arange(300), items)
    asked = np.concatenate([size.prints ^ np.packbits(g.random((300, 128)) < share, axis=1) for share in (0.1, 0.25, 0.35, 0.5)])
    got = {(int(i), int(j)) for which, item in size.near(asked) for i, j in zip(which, item, strict=True)}
    far = np.bitwise_count(asked.view(words.U)[:, None, :] ^ size.prints.view(words.U)[None, :, :]).sum(axis=2)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(far <= decontaminate.RADIUS)), strict=True))


def test_decontamination_of_long_items_and_clashing_columns(spark):
    """An item of 20,000 words, in a text that holds it twice and in one that lost a sixth; columns named like the operator's own."""
    r = random.Random(77)
    w = prose(r, 20000)
    docs = [" ".join(["before", *w, "between", *w]), " ".join(w[:17000] + [f"z{i}" for i in range(3000)]), " ".join(w[:15000])]
    d = table(spark, docs).withColumn("key", F.lit("k")).withColumn("item", F.lit("i")).withColumn("item_id", F.lit(1)).withColumn("similarity", F.lit(0.5))
    b = spark.createDataFrame([(1, " ".join(w), "t")], "item_id long, text string, key string")
    assert [(x.doc_id, round(x.similarity, 3), x.first_word) for x in decontaminate.find_benchmark(d, b).orderBy("doc_id").collect()] == [(0, 1.0, 1), (1, 0.85, 0)]
    left = decontaminate.drop_contaminated(d, b)
    assert left.columns == d.columns and [x.doc_id for x in left.collect()] == [2]


# ---- rules, models


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)


def test_rules(spark):
    r = random.Random(2)
    good = [" ".join(prose(r, r.randrange(15, 90))) for _ in range(120)]
    poor = [" ".join(x + "###" for x in prose(r, r.randrange(15, 60))) for _ in range(60)] + ["\n".join([" ".join(prose(r, 4))] * 30) for _ in range(20)]
    odd = [None, "", "a b a b a b a b a b a b", "x\nx\n\n \nx", "é " * 50, "a b c d e", "a b c d e a b c d e f"]
    texts = good + poor + odd
    df = table(spark, texts, [(None, "null id " * 5)]).withColumn("words", F.lit(1))
    labels = spark.createDataFrame([(i, False) for i in range(120)] + [(120 + i, True) for i in range(80)] + [(None, True), (3, None)], "doc_id long, poor boolean")
    rows = {x.doc_id: x for x in rules.judge(df, labels).collect()}
    for i, t in enumerate(texts):
        x = rows[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_counts(t)
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
    assert all(rows[i].kept for i in range(120)) and not any(rows[i].kept for i in range(120, 200))
    assert {x.kept for x in rules.judge(df, labels.limit(0)).where("not base_failed").collect()} == {True}
    assert rules.judge(df.limit(0), labels).count() == 0
    plan = rules.counts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_ordinal(spark):
    r = random.Random(4)
    texts, grades = [], []
    for i in range(900):
        w = prose(r, r.randrange(20, 120))
        g = i % 3
        if g == 0:
            w = [x + "!!" for x in w]
        if g == 1:
            w[r.randrange(len(w))] = r.choice(["idiotic", "trashy"])
        texts.append(" ".join(w))
        grades.append(g)
    df = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i % 2] + [(None, 1), (4, None)], "doc_id long, grade int")
    model = ordinal.fit_ordinal(df, labels)
    assert np.all(np.diff(model.thresholds) > 0)
    rows = {x.doc_id: x for x in ordinal.score_quality(df, model).collect()}
    held = [(rows[i].tail_probability >= 0.5) == (g == 2) for i, g in enumerate(grades) if not i % 2]
    assert sum(held) / len(held) > 0.95 and all(0 <= x.expected_grade <= 2 for x in rows.values()) and rows[900].score == 0
    kept = {x.doc_id for x in ordinal.select_quality(df, model).collect()}
    assert kept == {i for i, x in rows.items() if x.tail_probability >= 0.5}
    assert ordinal.fit_ordinal(df, labels.limit(0)) is None and ordinal.select_quality(df, None).count() == 902


def test_ordinal_objective_equals_brute_force():
    """The likelihood by its definition, and the gradients by differences."""
    g = np.random.default_rng(2)
    rows = [g.choice(6, g.integers(0, 5), replace=False) for _ in range(30)]
    grades, weight = g.integers(0, 4, 30), g.random(30)
    doc, at = np.repeat(np.arange(30), [len(r) for r in rows]), np.concatenate(rows)
    upward = np.array([True, False, True, False, True, False])
    value = ordinal.shares(doc, upward[at], 30)
    w, t = g.normal(size=6), np.array([-0.7, 0.2, 1.1])

    def loss(w, t):
        out = 0.05 * sum(x * x for x in w)
        for r, y, k in zip(rows, grades, weight, strict=True):
            ups = sum(bool(upward[f]) for f in r)
            s = sum(w[f] / ups if upward[f] else w[f] for f in r)
            tail = lambda j, s=s: 1.0 if j == 0 else 0.0 if j == 4 else 1 / (1 + math.exp(-(s - t[j - 1])))
            out -= k * math.log(tail(y) - tail(y + 1))
        return out

    got, g_w, g_t = ordinal.objective(w, t, (doc, at, value), grades, weight, 0.1)
    assert abs(got - loss(w, t)) < 1e-9
    for x, gradient, put in ((w, g_w, lambda v: (v, t)), (t, g_t, lambda v: (w, v))):
        for i in range(len(x)):
            step = np.eye(len(x))[i] * 1e-5
            assert abs((loss(*put(x + step)) - loss(*put(x - step))) / 2e-5 - gradient[i]) < 1e-6
    model = ordinal.OrdinalModel(np.concatenate([w, np.zeros((1 << ordinal.BITS) - 6)]).astype(np.float32), t, np.concatenate([upward, np.zeros((1 << ordinal.BITS) - 6, bool)]))
    for r, s in zip(rows, model.scores(doc, at, 30), strict=True):
        assert abs(s - sum(w[f] / sum(upward[r]) if upward[f] else w[f] for f in r)) < 1e-5


def test_ordinal_learns_both_ways_and_odd_tables(spark):
    """Words that only good texts have count; empty texts are graded as labelled empty ones; nulls, clashing columns, empty tables."""
    r = random.Random(3)
    good, poor = [f"fine{i}" for i in range(8)], [f"bad{i}" for i in range(8)]
    texts = [" ".join([*prose(r, 20), *r.sample(good, 3)]) for _ in range(150)] + [" ".join([*prose(r, 20), *r.sample(poor, 3)]) for _ in range(150)] + [""] * 40
    grade = [2] * 150 + [0] * 190
    d = table(spark, texts, [(None, "fine1 fine2 fine3"), (1000, None), (1001, " ".join(["fine1", "fine2", *prose(r, 30)])), (1002, " ".join([*poor[:3], *prose(r, 30)]))])
    d = d.withColumns({"key": F.lit(1), "score": F.lit(2), "grade": F.lit(3), "features": F.lit(4)})
    labels = spark.createDataFrame([*enumerate(grade), (None, 2), (5, None), (7, 9)], "doc_id long, grade int")
    model = ordinal.fit_ordinal(d, labels)
    got = {x.doc_id: x.tail_probability for x in ordinal.score_quality(d, model).collect()}
    assert got[1001] > 0.5 > got[1002] and got[1000] < 0.5 and got[300] < 0.5 and got[None] > 0.5
    assert model.weights[model.upward].max() > 0
    kept = ordinal.select_quality(d, model)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {i for i, p in got.items() if p >= 0.5}
    assert ordinal.score_quality(d.limit(0), model).count() == 0 and ordinal.fit_ordinal(d.limit(0), labels) is None and ordinal.fit_ordinal(d, labels.limit(0)) is None
    assert all(x.tail_probability == 1 for x in ordinal.score_quality(d, None).collect())


def test_hmm_likelihood_and_training():
    m = hmm.first_model(np.array([5.0, 3, 2, 1]), states=2)
    r = np.random.default_rng(0)
    texts = [r.integers(0, 4, n).astype("<u2") for n in (1, 3, 5, 0)]
    got = m.log10(texts)
    for t, g in zip(texts, got, strict=True):
        total = sum(np.prod([m.first[p[0]] * m.emits[p[0], t[0]], *(m.moves[a, b] * m.emits[b, x] for a, b, x in zip(p[:-1], p[1:], t[1:], strict=True))]) for p in itertools.product(range(2), repeat=len(t))) if len(t) else 1
        assert abs(g - math.log10(total)) < 1e-9
    first, moves, emits = m.expected(texts)
    assert abs(first.sum() - 3) < 1e-9 and abs(moves.sum() - 6) < 1e-9 and abs(emits.sum() - 9) < 1e-9
    # Expected counts by enumeration of all paths.
    for got, want in zip((first, moves, emits), counted(m, texts), strict=True):
        assert np.allclose(got, want, atol=1e-9)


def counted(m, texts):
    """Expected counts over all paths of states, each by its probability given the text."""
    first, moves, emits = np.zeros_like(m.first), np.zeros_like(m.moves), np.zeros_like(m.emits)
    states = range(len(m.first))
    for t in texts:
        if not len(t):
            continue
        paths = list(itertools.product(states, repeat=len(t)))
        p = np.array([np.prod([m.first[q[0]] * m.emits[q[0], t[0]], *(m.moves[a, b] * m.emits[b, x] for a, b, x in zip(q[:-1], q[1:], t[1:], strict=True))]) for q in paths])
        for q, w in zip(paths, p / p.sum(), strict=True):
            first[q[0]] += w
            for a, b in itertools.pairwise(q):
                moves[a, b] += w
            for a, x in zip(q, t, strict=True):
                emits[a, x] += w
    return first, moves, emits


def test_hmm_long_texts_are_exact(monkeypatch):
    """Segments change nothing: counts by enumeration for short segments, and likelihoods of a long text by one recursion."""
    g = np.random.default_rng(4)
    m = hmm.Model(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.4, 0.6]]), g.dirichlet(np.ones(5), 2))
    texts = [g.integers(0, 5, n).astype("<u2") for n in (10, 7, 9, 3, 1)]
    long = [g.integers(0, 5, n).astype("<u2") for n in (5000, 4097, 2049, 800)]
    whole = m.log10(texts), m.log10(long)
    monkeypatch.setattr(hmm, "LONG", 1 << 40)
    plain = m.log10(long), m.expected(long)
    assert np.allclose(whole[1], plain[0], atol=1e-6)
    for segment in (1, 2, 3, 512):
        monkeypatch.setattr(hmm, "SEGMENT", segment)
        monkeypatch.setattr(hmm, "LONG", 2)
        assert np.allclose(m.log10(texts), whole[0], atol=1e-9)
        for got, want in zip(m.expected(texts), counted(m, texts), strict=True):
            assert np.allclose(got, want, atol=1e-9)
    for got, want in zip(m.expected(long), plain[1], strict=True):
        assert np.allclose(got, want, atol=1e-6)


def test_hmm_memory_does_not_depend_on_the_mix_of_lengths():
    """Half a million texts of one word beside one of 20,000."""
    import tracemalloc

    m = hmm.first_model(np.ones(100))
    texts = [np.array([3, 0], "<u2")] * 500_000 + [np.arange(20_001, dtype="<u2") % 100]
    tracemalloc.start()
    first, moves, emits = m.expected(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(first.sum() - 500_001) < 1e-3 and abs(emits.sum() - 1_020_001) < 1e-3 and abs(moves.sum() - 520_000) < 1e-3
    assert most < 300 << 20


def test_hmm_scores(spark):
    r = random.Random(6)
    texts = [" ".join(prose(r, r.randrange(1, 60))) for _ in range(300)] + [None, "", "unseen words here"]
    df = table(spark, texts, [(None, "the of")])
    rows = hmm.score_lm(df, rounds=2)
    small = {x.doc_id: x for x in hmm.score_lm(df, rounds=2, table=20).collect()}
    tok = lambda t: [*brute_words(t), None]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(x for i, t in [*enumerate(texts)] if not out(i) for x in tok(t)) + collections.Counter(tok("the of"))
    n, v = sum(c.values()), len(c)
    for x in rows.collect():
        t = texts[x.doc_id] if x.doc_id is not None else "the of"
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t))
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (x.doc_id is not None and out(x.doc_id), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n)
        assert abs(x.base_score - base) < 1e-6 and abs(small[x.doc_id].base_score - base) < 1e-6 and x.score < 0
        assert small[x.doc_id].n_known == x.n_known
    assert hmm.score_lm(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_hmm_counts_the_end_of_few_texts(spark, n):
    """The end token occurs too rarely, or less than all tokens that the table holds."""
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    texts = ["a a a a b b b b c c c d"] * n
    ids = [i for i in range(40) if not out(i)][:n]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    c = collections.Counter(x for t in texts for x in [*t.split(), None])
    total, distinct = sum(c.values()), len(c)
    base = sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in [*texts[0].split(), None])
    scores = []
    for size in (hmm.TABLE, 2):
        for x in hmm.score_lm(df, rounds=1, table=size).collect():
            assert (x.n_tokens, x.n_known, x.train_tokens) == (13, 13, total)
            assert abs(x.base_score - base) < 1e-6 and x.score < 0
            scores.append(x.score)
    assert len(scores) == 2 * n


# ---- secrets


def brute_base(t):
    out = []
    for m in re.finditer(r"(?ia:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (name, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)), 1):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t) if m.end() - m.start() >= least]
    return ",".join(x[2] for x in sorted(out))


def test_secrets_base_equals_brute_force(spark):
    r = random.Random(8)
    pieces = ["password", "Passwd", "ſecret", "secret", "TOKEN", "api_key", "APIKEY", '"', "'", " ", ":", "=", "é", "\n", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeefdeadbeef", "hunter2hunter2", "😀"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(12))) for _ in range(1500)] + [None, ""]
    got = {x.doc_id: x for x in secrets.secret_digests(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("literal")] == [x for x in want.split(",") if x]
        assert got[i].n_access == want.count("access:")


def test_secrets_lexing():
    literal = lambda t: [t[s.start : s.end] for s in secrets.scan(t) if s.kind == "literal"]
    assert literal('dbPwd = "kX9$tq2!mZ"') == ["kX9$tq2!mZ"]
    assert literal("PASS1 = 'Zk3!vq8Lw'\nconn.credentials = PASS1\n") == ["Zk3!vq8Lw"]
    assert literal('x = "Qz7!pL2#rT9"\nauth_secret_value = x\n') == ["Qz7!pL2#rT9"]
    assert literal("<clientPassphrase>g7Hq-22Lm!x</clientPassphrase>") == ["g7Hq-22Lm!x"]
    assert literal('{"private_key": "a8F#k2Lq9Z", "title": "a8F#k2Lq9Z"}') == ["a8F#k2Lq9Z"]
    assert literal('cfg.setPassphrase("t5Gh!28xQ")') == ["t5Gh!28xQ"]
    for clean in ("the key: was found", 'title = "kX9$tq2!mZ"', 'pwd = "${DB_PWD}"', 'passphrase = "changeme"', "pass: through it", "monkey = banana", 'my_pwd = ""'):
        assert literal(clean) == []
    assert secrets.redact('a password="abcd1234!" b', secrets.base_spans('a password="abcd1234!" b')) == 'a password="[SECRET]!" b'


def test_secrets_without_caps():
    literal = lambda t: [t[s.start : s.end] for s in secrets.scan(t) if s.kind == "literal"]
    r = random.Random(4)
    parts = ["".join(r.choice("aB3xYz9Qw7!kLm") for _ in range(14)) + str(i) for i in range(60)]
    joined = "x = " + " + ".join(f'"{p}"' for p in parts)
    assert literal(f"{joined}\ndb_pwd = x\n") == parts
    assert literal("".join(f'x = x + "{p}"\n' for p in ["", *parts]) + "db_pwd = x\n") == parts
    assert len(literal('x = "aB3xYz9Qw7"\n' + "x = x + x\n" * 5000 + "db_pwd = x\n")) == 1
    for n in (4096, 4500, 300_000):
        long = "".join(r.choice("aB3xYz9Qw7/kLm") for _ in range(n))
        for t in (f'private_key = "{long}"', f"private_key: '{long}'", f"private_key = `{long}`", f"<private_key>{long}</private_key>", f'setPassphrase("{long}")'):
            assert literal(t) == [long] and long not in secrets.redact(t, secrets.scan(t))


def test_secrets_in_configuration_and_over_lines():
    literal = lambda t: [t[s.start : s.end] for s in secrets.scan(t) if s.kind == "literal"]
    for ref in ("$K", "${K}", '"$K"', '"${K}"', "K"):
        assert literal(f"K=aB3xYz9Qw77\nDB_PWD={ref}\n") == ["aB3xYz9Qw77"]
    assert literal("K=aB3xYz9Qw77\nL=${K}\ndb_pwd: $L\n") == ["aB3xYz9Qw77"]
    key = "aB3xYz9Qw77kLmaB3xYz9Qw77kLm"
    for t in (f'{{"db_pwd":\n  "{key}"}}', f"db_pwd =\n  '{key}'", f"db_pwd: |\n  {key}\nx: y\n", f"db_pwd: >-\n\n   {key}", f'db_pwd = """\n{key}\n"""', "db_pwd = " + 3 * "'" + key + 3 * "'", f"db_pwd:\n  {key}\n", f"conf: |\n  db_pwd = '{key}'\n  x: y\n", f"<db_pwd>\n{key}\n</db_pwd>", f"-----BEGIN RSA PRIVATE KEY-----\n{key}\n-----END RSA PRIVATE KEY-----", f'x: `a\ndb_pwd = "{key}"\n`'):
        assert literal(t) == [key], t
    for clean in ('db_pwd:\n  "aB3xYz9Qw77": 5', "db_pwd:\n  aB3xYz9Qw77: 5", "K=aB3xYz9Qw77\ntitle=$K", "the password:\nwas found", 'db_pwd: |\ntitle: "aB3xYz9Qw77"', "DB_PWD=${K}"):
        assert literal(clean) == [], clean


# ---- pipeline


def test_secrets_constants_reach_their_targets_in_any_order():
    key = "aB3xYz9Qw77Lm"
    for text in (
        f"conn.passphrase = x\nx = '{key}'\n",
        f"login(passphrase=a)\na = b\nb = c\nc = '{key}'\n",
        f"passphrase = first + second\nsecond = '{key}'\n",
        f"a = b\nb = a\npassphrase = a\nb = '{key}'\n",
        f"{'x' * 200}_passphrase = '{key}'\n",
        f"set{'Very' * 40}LongPassphrase('{key}')\n",
        f"9settings.db_passphrase: '{key}'\n",
    ):
        assert [(s.kind, text[s.start : s.end]) for s in secrets.scan(text)] == [("literal", key)], text
    assert secrets.scan(f"colour = x\nx = '{key}'\n") == [] and secrets.scan(f"passphrase = x\ny = '{key}'\n") == []


def test_secrets_lexing_is_linear():
    for text in ("a" * 10**6, "a1" * 500_000, "a.b-" * 250_000, "passphrase = " * 60_000, "'" * 300_000, "settings" * 100_000, "<key>" * 100_000):
        began = time.time()
        secrets.scan(text)
        assert time.time() - began < 5


def test_secrets_odd_tables(spark):
    """Null ids, null and repeated texts, columns named like the operator's own, empty tables."""
    t = "passphrase = 'aB3xYz9Qw77Lm'"
    d = spark.createDataFrame([(None, t, "k"), (1, None, "k"), (2, t, "k"), (2, t, "k"), (3, "", "k")], "doc_id long, text string, spans string").withColumn("key", F.lit(7))
    got = sorted(((r.doc_id or 0), len(r.spans)) for r in secrets.find_secrets(d).collect())
    assert got == [(0, 1), (1, 0), (2, 1), (2, 1), (3, 0)]
    clean = secrets.redact_secrets(d)
    assert clean.columns == d.columns and [r.text for r in clean.collect() if r.text] == ["passphrase = '[SECRET]'"] * 3
    assert secrets.find_secrets(d.limit(0)).count() == 0 and secrets.redact_secrets(d.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(12)
    base = [" ".join(prose(r, 80)) for _ in range(60)]
    item = " ".join(prose(r, 25))
    texts = [*base, base[0], base[1] + " tail", "junk!! " * 3 + " ".join(x + "!!" for x in prose(r, 60)), base[2] + " " + item, base[3] + " password=abcdef123456 end", None, ""]
    texts += [" ".join(x + "!!" for x in prose(r, 50)) for _ in range(40)]
    df = table(spark, texts)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(len(texts) - 1 - i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = {x.doc_id: x for x in docs.collect()}
        assert name == "encode" or docs.columns == columns
    assert set(range(60)) <= set(seen["quality"]) and 62 not in seen["quality"] and not set(range(67, 107)) & set(seen["quality"])
    assert 60 not in seen["near_duplicates"] and 61 not in seen["near_duplicates"] and 0 in seen["near_duplicates"]
    assert set(seen["near_duplicates"]) - set(seen["decontaminate"]) == {63} & set(seen["near_duplicates"])
    if 64 in seen["secrets"]:
        assert "[SECRET]" in seen["secrets"][64].text and seen["secrets"][64].n_chars == len(seen["secrets"][64].text)
    t = Tokenizer.from_file(BYTES)
    for i, x in seen["encode"].items():
        assert x.ids == t.encode(seen["secrets"][i].text or "", add_special_tokens=False).ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["encode"])


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")
def test_pipeline_equals_brute_force(spark):
    """Each stage on the rows that its predecessor kept, against a plain version of it."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = {r.item_id: brute_words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    model = ordinal.fit_ordinal(docs, labels.select("doc_id", ordinal.grade_of(F.col("quality"), F.col("toxic")).alias("grade")))
    tokenizer = Tokenizer.from_file(BYTES)

    def top_grade(text):
        _, found = ordinal.features(words.words_of(pa.array([text], pa.string())))
        for_, against = [f for f in found if model.upward[f] and model.weights[f]], [f for f in found if not model.upward[f]]
        s = sum(float(model.weights[f]) for f in against) + sum(float(model.weights[f]) for f in for_) / max(len(for_), 1)
        return 1 / (1 + math.exp(-(s - model.thresholds[-1])))

    def contaminated(text):
        w = brute_words(text)
        have = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        for v in items.values():
            k = min(5, len(v))
            grams = lambda x, k=k: [tuple(x[j : j + k]) for j in range(len(x) - k + 1)]
            if not v or k == 5 and sum(g in have for g in grams(v)) < 0.8 * (len(v) - 4) - 1e-9:
                continue
            want = collections.Counter(grams(v))
            if any(sum((collections.Counter(grams(w[j : j + len(v)])) & want).values()) >= 0.8 * (len(v) - k + 1) - 1e-9 for j in range(max(1, len(w) - len(v) + 1))):
                return True
        return False

    def without_secrets(text):
        return text if text is None else secrets.redact(text, secrets.scan(text))

    plain = {
        "quality": lambda rows: [r for r in rows if top_grade(r.text) >= 0.5],
        "near_duplicates": lambda rows, found=brute_components: [r for c in [found([(x.doc_id, x.text) for x in rows])] for r in rows if c[r.doc_id][1] == r.doc_id],
        "decontaminate": lambda rows: [r for r in rows if not contaminated(r.text)],
    }
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(before, docs.schema), SMALL)
        got = {r.doc_id: r for r in out.collect()}
        if name in plain:
            assert out.columns == docs.columns
            assert {i: r.text for i, r in got.items()} == {r.doc_id: r.text for r in plain[name](before)}, name
        elif name == "secrets":
            assert {i: r.text for i, r in got.items()} == {r.doc_id: without_secrets(r.text) for r in before}
            for r in before:  # every base secret is gone, by the patterns themselves
                for value in re.findall(r"AKIA[A-Z0-9]{12,}", r.text or ""):
                    assert value not in got[r.doc_id].text
        else:
            assert {i: r.ids for i, r in got.items()} == {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in before}
        before = list(got.values())
    assert 0 < len(before) < docs.count()


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids and texts, columns named like the stages' own, and empty tables pass through every stage."""
    texts = ["alpha beta gamma delta epsilon zeta", None, "", "alpha beta gamma delta epsilon zeta"]
    docs = table(spark, texts, [(None, "one two three four five six")]).withColumns({"key": F.lit(1), "sid": F.lit("s"), "item": F.lit(2), "grade": F.lit(0), "part": F.lit(3)})
    for at, (d, keep) in enumerate(((docs, None), (docs.limit(0), 0))):
        folder = f"{tmp_path}/{at}"
        d.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        held = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            columns, held = held.columns, stage(spark, held, folder)
            assert name == "encode" or held.columns == columns
        got = sorted(r.doc_id if r.doc_id is not None else -1 for r in held.collect())
        assert got == ([-1, 0, 1, 2] if keep is None else [])


def test_rules_follow_the_labels(spark):
    """Documents of one measure that labels call poor: the learnt conditions, applied by hand to the measures, give the same verdicts."""
    r = random.Random(21)
    texts = [" ".join(prose(r, 60)) + " #*$ " * r.randrange(3) for _ in range(200)] + [" ".join(prose(r, 60)) + " #*$%& " * r.randrange(20, 40) for _ in range(100)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, i >= 200) for i in range(300) if i % 2], "doc_id long, poor boolean")
    got = rules.judge(docs, labels).collect()
    wrong = sum((x.kept == (x.doc_id >= 200)) for x in got if not x.base_failed)
    assert wrong <= 3
    symbols = {x.doc_id: x.n_symbols for x in got}
    assert all(symbols[i] == sum(c in "#*$%&|<>" for c in t) for i, t in enumerate(texts))


def test_rules_are_grown_and_pruned_as_by_brute_force(spark):
    """Sequential covering by trying every condition on every row, with the operator's own tie order, gives the same list."""
    g = np.random.default_rng(11)
    names = list(rules.MEASURES)
    edges = [sorted(g.random(3).tolist()) for _ in names]
    bins = g.integers(0, 4, (900, len(names)))
    poor = (bins[:, 2] > 1) & (bins[:, 5] <= 2) & (g.random(900) < 0.97) | (bins[:, 0] > 2) & (g.random(900) < 0.95)
    back = g.random(900) < 1 / 3
    df = spark.createDataFrame([(bool(p), [int(x) for x in b], bool(k)) for p, b, k in zip(poor, bins, back, strict=True)], "poor boolean, bins array<int>, prune boolean")
    holds = lambda conditions, b: np.all([b[:, names.index(c.measure)] > c.bin if c.above else b[:, names.index(c.measure)] <= c.bin for c in conditions], axis=0) if conditions else np.ones(len(b), bool)

    def grown(b, p):
        chosen = ()
        while len(chosen) < rules.MOST_CONDITIONS:
            at = holds(chosen, b)
            total_p, total_n = (at & p).sum(), (at & ~p).sum()
            if not total_p or not total_n:
                break
            best = None
            for m, name in enumerate(names):
                for k, edge in enumerate(edges[m]):
                    for above in (False, True):
                        hit = at & holds((rules.Condition(name, above, edge, k),), b)
                        pos, neg = (hit & p).sum(), (hit & ~p).sum()
                        if pos + neg >= rules.LEAST_COVERED and pos:
                            gain = pos * (math.log2(pos / (pos + neg)) - math.log2(total_p / (total_p + total_n)))
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, rules.Condition(name, above, edge, k))
            if best is None or best[0] <= 1e-9:
                break
            chosen += (best[1],)
        return chosen

    def pruned_(conditions, b, p, k):
        best = None
        for i in range(len(conditions)):
            hit = holds(conditions[: i + 1], b)
            pos, neg = (hit & p & k).sum(), (hit & ~p & k).sum()
            worth = (pos - neg) / (pos + neg) if pos + neg else -1.0
            if best is None or worth >= best[0]:
                best = (worth, i, pos, neg, hit)
        _, i, pos, neg, hit = best
        precision, held_back = (hit & p).sum() / max(hit.sum(), 1), pos / (pos + neg) if pos + neg else 1.0
        return conditions[: i + 1] if hit.sum() >= rules.LEAST_COVERED and min(precision, held_back) >= rules.LEAST_PRECISION else None

    left, alive, found = df, np.ones(900, bool), 0
    for _ in range(rules.MOST_RULES):
        want = grown(bins[alive & ~back], poor[alive & ~back])
        got = rules.grow(left.where("not prune"), edges)
        assert (got.conditions if got else ()) == want
        kept = pruned_(want, bins[alive], poor[alive], back[alive]) if want else None
        rule = rules.prune(left, got) if got else None
        assert (rule.conditions if rule else None) == kept
        if rule is None:
            break
        assert rule.covered == (alive & holds(kept, bins)).sum()
        alive, left, found = alive & ~holds(kept, bins), left.where(~rule.binned()), found + 1
    assert found >= 2
