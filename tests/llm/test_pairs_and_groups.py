"""Token alignment, near-duplicate vectors and spelling variants against brute force; words that a polynomial hash confuses."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import align, bpe, decontaminate, hmm, parity, spelling, sstable, vectors, words
from weftline.llm.shared import shared_dir
from weftline.llm.tokenizer_files import tokenizer_path

BYTES, PIECES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)


# ---- words that collide under polynomials modulo 2^64


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s[:n], s[:n].translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 128, 256, 1024, 4096])
def test_thue_morse_words_differ(n):
    x, y = thue_morse(n)
    assert len(set(words.words_of(pa.array([x, y])).hashes.tolist())) == 2


def test_thue_morse_words_in_each_operator(spark):
    texts = [t for n in (1024, 4096) for t in thue_morse(n)]
    docs = documents(spark, list(enumerate(texts)))
    lib = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r.ids for r in bpe.bpe_encode(docs, BYTES).collect()}
    assert got == {i: lib.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    folder, other = shared_dir(spark, "tm"), Tokenizer.from_file(WORDS)
    sstable.write_shards(docs, folder, WORDS, end_id=2)
    crc = {r.doc_id: r.ids_crc32 for r in sstable.read_shards(spark, folder).collect()}
    assert crc == {i: zlib.crc32(np.array([*other.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.component_id for r in parity.near_duplicates(docs).collect()} == {i: i for i in range(4)}
    for train, apart in (([0], 1), ([2], 3)):
        ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 != 2][:1] + [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
        scored = {r.doc_id: r for r in hmm.score_lm(documents(spark, [(ids[0], texts[train[0]]), (ids[1], texts[apart])])).collect()}
        assert scored[ids[1]].n_known == 1  # the end token alone
    item = spark.createDataFrame([(0, f"one two {texts[2]} three four five six")], "item_id long, text string")
    assert decontaminate.find_benchmark(documents(spark, [(0, f"one two {texts[3]} three four five six")]), item).count() == 0
    assert decontaminate.find_benchmark(documents(spark, [(0, f"one two {texts[2]} three four five six")]), item).count() == 1


def test_chunks_of_one_hash_are_told_apart(monkeypatch):
    """Even with a hash of two values every chunk gets its own ids."""
    from weftline.llm import chunks

    monkeypatch.setattr(chunks, "range_hashes", lambda raw, a, b, salt=0: (b - a).astype(np.uint64) % np.uint64(2))
    b, lib = bpe.TrieBpe(open(BYTES, encoding="utf-8").read()), Tokenizer.from_file(BYTES)
    held = ["one two three onetwothreefourfivesixseven", "onetwothreefourfivesixeight two eno", *thue_morse(64)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in b.encode_batch(pa.array(held))] == [x.ids for x in lib.encode_batch(held, add_special_tokens=False)]


# ---- token alignment

ODD = [None, "", " ", "  ", "a", "  a  b ", "▁x", "▁", "<s>", "<|endoftext|> x", "\n\n a\t", "é b", "日本語 テスト 😀😀", "x" * 9000, "a   b", "ﬁ ①", "é x", "a\x00b", "<0x41>", " lead", "trail "]


def align_brute(rows):
    a_of, b_of = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_of.encode_special_tokens = True
    stand = bpe.byte_alphabet()
    held, in_docs = [], collections.Counter()
    for key, text in rows:
        want = f" {text}".encode()
        a = a_of.encode(want.decode(), add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        a_bytes = [bytes(stand[c] for c in a_of.id_to_token(t)) for t in a]
        b_bytes = [bytes([int(b_of.id_to_piece(t)[3:5], 16)]) if b_of.is_byte(t) else b_of.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            held.append((key, [], [], [], ""))
            continue
        spans = []
        for tokens in (a_bytes, b_bytes):
            at, mine = 0, []
            for t in tokens:
                mine.append((at, at + len(t)))
                at += len(t)
            spans.append(mine)
        links, j0 = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and spans[1][j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, p, q = [], 0, 0
        for cut in both:
            i, j = p, q
            while p < len(a) and spans[0][p][1] <= cut:
                p += 1
            while q < len(b) and spans[1][q][1] <= cut:
                q += 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        in_docs.update(set(links))
        held.append((key, a, b, links, ";".join(groups)))
    best = collections.Counter()
    for (a, _), n in in_docs.items():
        best[a] = max(best[a], n)
    return sorted(
        ((key, len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(in_docs[x] == best[x[0]] for x in links), sum(in_docs[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for key, a, b, links, g in held),
        key=str,
    )


def aligned(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@pytest.fixture(scope="module")
def prose():
    r = random.Random(3)
    bits = ["the", "ing", "tion", "é", "ou", "wh", "st", "Ab", "x9", "--", "\n"]
    return [" ".join("".join(r.choice(bits) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 60))) for _ in range(120)]


@pytest.mark.parametrize("table", [align.TABLE, 40, 0])
def test_alignment_equals_brute_force(spark, prose, table):
    rows = list(enumerate([*ODD, *prose, prose[0], prose[0]])) + [(0, prose[1]), (None, prose[2])]
    assert aligned(align.align_tokens(documents(spark, rows).repartition(5), BYTES, PIECES, table=table)) == align_brute(rows)


def test_alignment_gives_out_pairs_in_between(spark, prose, monkeypatch):
    monkeypatch.setattr(align, "HELD", 50)
    monkeypatch.setattr(align, "SLICE_BYTES", 500)
    rows = list(enumerate(prose[:40]))
    assert aligned(align.align_tokens(documents(spark, rows), BYTES, PIECES)) == align_brute(rows)


def test_alignment_of_odd_tables(spark):
    assert aligned(align.align_tokens(documents(spark, []), BYTES, PIECES)) == []
    clash = documents(spark, [(1, "one two")]).selectExpr("doc_id", "text", "1 as key", "2 as n_a", "3 as pair", "4 as row", "5 as rest")
    assert aligned(align.align_tokens(clash, BYTES, PIECES)) == align_brute([(1, "one two")])


# ---- vectors


def vectors_brute(rows, threshold=0.93):
    good = [i for i, (k, v, g) in enumerate(rows) if k is not None and g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = collections.defaultdict(set)
    for x in good:
        for y in good:
            if x < y and rows[x][2] == rows[y][2] and len(rows[x][1]) == len(rows[y][1]):
                u, v = np.array(rows[x][1], float), np.array(rows[y][1], float)
                if (u * v).sum() / (np.sqrt((u * u).sum()) * np.sqrt((v * v).sum())) >= threshold:
                    links[x].add(y)
                    links[y].add(x)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        low = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(links[j]), low, rows[j][0] is None or rows[j][0] == low)
    return sorted(out, key=str)


def vector_rows(n=260, width=12, seed=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, width))
    rows = []
    for i in range(n):
        v = centres[r.integers(8)] + r.normal(size=width) * r.choice([0.02, 0.3, 0.45, 1.0])
        rows.append((i * 3, [float(np.float32(x)) for x in v], int(r.integers(3)) if i % 17 else None))
    some = rows[4][1]
    rows += [(1000 + i, some, rows[4][2]) for i in range(30)]  # equal vectors
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * width, 1), (2003, [None, *some[1:]], 1), (2004, [float("nan"), *some[1:]], 1), (2005, [float("inf"), *some[1:]], 1)]
    rows += [(None, some, rows[4][2]), (2006, some[:5], 1), (2007, some[:5], 1), (2007, some[:5], 1), (2008, [2 * x for x in some], rows[4][2])]
    return rows


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize(("kind", "tile"), [("float", 2048), ("double", 16), ("float", 7)])
def test_vectors_equal_brute_force(spark, monkeypatch, kind, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "ROWS", 5)
    rows = vector_rows()
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    assert found(vectors.near_vectors(df)) == vectors_brute(rows)


def test_vectors_at_the_threshold(spark):
    """0.6 * 0.6 + 0.8 * 0.8 and cosines a few units of the last place about the threshold."""
    rows, near = [], math.sqrt(1 - 0.93**2)
    for i, y in enumerate([near, np.nextafter(near, 0), np.nextafter(near, 1), near + 1e-12, near - 1e-12]):
        rows += [(10 * i, [1.0, 0.0], i), (10 * i + 1, [0.93, float(y)], i)]
    assert found(vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))) == vectors_brute(rows)


def test_vectors_of_a_chain_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 8)
    rows = [(500 - i, [math.cos(i / 100), math.sin(i / 100), 0.0], "a") for i in range(300)]
    assert found(vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))) == vectors_brute(rows)


def test_vectors_of_odd_tables(spark):
    assert found(vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))) == []
    rows = [(1, None, None), (2, [1.0], None), (None, None, 3)]
    assert found(vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))) == vectors_brute(rows)
    clash = spark.createDataFrame([(1, [1.0, 2.0], 0, 7, 8), (2, [1.0, 2.0], 0, 7, 8)], "vec_id int, embedding array<float>, label int, key int, name int")
    assert found(vectors.near_vectors(clash)) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_alignment_encodes_each_text_once(spark):
    rows = [(i, f"some words and {'x' * (i % 7)}{i}\u2581" if i % 5 == 0 else f"more words, {i * i} of them") for i in range(60)]
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    docs = documents(spark, rows).withColumn("text", F.udf(read)("text"))
    assert aligned(align.align_tokens(docs, BYTES, PIECES)) == align_brute(rows)
    assert seen.value == len(rows)


def test_parity_rounds_take_few_tasks(spark):
    """Rounds move little where few sets share blocks; with many shuffle partitions each step took as many tasks."""
    r, said = random.Random(3), [f"w{i}" for i in range(400)]
    texts = [[r.choice(said) for _ in range(60)] for _ in range(40)]
    rows = [(100 * i + k, " ".join(x[: 60 - k])) for i, x in enumerate(texts) for k in range(3)]
    had, tracker = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("parity-rounds", "parity")
    try:
        got = {x.doc_id: x.component_id for x in parity.near_duplicates(documents(spark, rows)).collect()}
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("parity-rounds")]
        stages = [tracker.getStageInfo(k) for k in {k for j in jobs if j for k in j.stageIds}]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", had)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: i // 100 * 100 for i in got} and len(got) == 120
    assert sum(x.numCompletedTasks for x in stages if x) < 640  # 743 where each shuffle has 48


# ---- spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_brute(rows):
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    held = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    around = {w: [v for v in held if near(w, v)] for w in held}
    form = {}
    for w, some in around.items():
        best = min(some, key=lambda v: (-held[v], v), default=None)
        form[w] = best if best is not None and held[best] >= 10 * held[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), c, len(around[w]), held[form[w]] if form[w] else None) for w, c in held.items())


def grouped(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("limits", [{}, {"SHARD_WORDS": 9, "PASS_LETTERS": 600, "BLOCK": 4}, {"SHARD_LETTERS": 400, "PASS_LETTERS": 3000}])
def test_spelling_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(spelling, name, value)
    r, bits, rows = random.Random(8), ["lettre", "Hand", "éa", "ou", "tion", "ÿa", "Éb", "ww", "ss"], []
    pool = ["".join(r.choice(bits) for _ in range(3)) for _ in range(25)]
    for i in range(150):
        said = []
        for _ in range(60):
            w = r.choice(pool[: r.choice([3, 25])])
            if r.random() < 0.06:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("aeÿ") + w[k:], w[:k] + r.choice("aeÿ") + w[k + 1 :]])
            said.append(w)
        rows.append((i, " ".join(said)))
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (900, None), (901, ""), (902, "a1b2 ... 日本"), (903, "q" * 5000 + " " + "q" * 5000 + " " + "q" * 5001 + " x" + "q" * 5001)]
    want = spelling_brute(rows)
    assert any(w[1] for w in want) and max(w[4] for w in want) > 3
    assert grouped(spelling.group_spellings(documents(spark, rows).repartition(3))) == want


@pytest.mark.parametrize("limits", [{}, {"SHARD_WORDS": 20, "PASS_LETTERS": 900}])
def test_spelling_of_words_in_many_files(spark, monkeypatch, limits):
    """Spark reads larger files first and several in a task, so files of sorted words don't come in order."""
    for name, value in limits.items():
        monkeypatch.setattr(spelling, name, value)
    r, rows = random.Random(5), []
    for k in range(14):  # ever longer words towards the end of the alphabet, and ties between first letters
        stem = "".join(r.choice("aeiouÿ") for _ in range(7 + 3 * k))
        rows += [(100 * k + i, " ".join([c + stem] * times)) for i, (c, times) in enumerate([("b", 30), ("n", 30), ("z", 30), ("é", 30), ("m", 2), ("p", 3)])]
        rows.append((100 * k + 50, " ".join([chr(98 + k) + stem + "xy"[i % 2] for i in range(8)])))
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = grouped(spelling.group_spellings(documents(spark, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    assert got == spelling_brute(rows)


def test_spelling_chain_of_forms(spark):
    text = " ".join(["chainaaa"] * 2 + ["chainaab"] * 20 + ["chainabb"] * 200 + ["chainbbb"] * 2000)
    rows = [(next(i for i in range(99) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in set(text.split()))), text)]
    got = grouped(spelling.group_spellings(documents(spark, rows)))
    assert got == spelling_brute(rows) and got[0][2] == "chainbbb"


def test_spelling_of_odd_tables(spark):
    assert grouped(spelling.group_spellings(documents(spark, []))) == []
    assert grouped(spelling.group_spellings(documents(spark, [(1, None), (2, "short words"), (None, None)]))) == []
    clash = documents(spark, [(1, "wonderful wonderful")]).selectExpr("doc_id", "text", "1 as id", "2 as run", "3 as word", "4 as n")
    assert grouped(spelling.group_spellings(clash)) == spelling_brute([(1, "wonderful wonderful")])


# ---- hot ids in token shards, many secrets in one text


def test_shards_spread_a_hot_id(spark):
    r = random.Random(2)
    rows = [(None if i % 10 else i, f"text {r.randrange(10**6)}") for i in range(2000)] + [(5, "five")] * 3
    folder = shared_dir(spark, "hot")
    told = sstable.write_shards(documents(spark, rows).repartition(7), folder, WORDS, end_id=2)
    assert len(told) > 1 and max(t["entries"] for t in told) < 0.5 * len(rows)
    lib = Tokenizer.from_file(WORDS)
    ids = [(k, lib.encode(t, add_special_tokens=False).ids + [2]) for k, t in rows]
    got = sstable.read_shards(spark, folder).collect()
    want = sorted((str(k), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in ids)
    assert sorted((str(g.doc_id), g.n_tokens, g.ids_crc32) for g in got) == want
    at = 0
    for g in sorted(got, key=lambda g: g.start):  # each row begins where the one before it ended, null ids first
        assert g.start == at
        at += g.n_tokens
    keys = [g.doc_id for g in sorted(got, key=lambda g: g.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert sstable.lookup(folder, 5).tolist() == ids[-1][1] and sstable.lookup(folder, 7) is None and sstable.lookup(folder, 10**9) is None
    assert sstable.lookup(folder, 40).tolist() == dict(ids)[40] and sstable.lookup(folder, None) is not None


def test_many_secrets_in_one_text_take_linear_time():
    import time

    from weftline.llm import secrets

    line = "password = 'hunter2hunter2'\npassphrase = \"corr3ct-H0rse\"\n"
    began = time.time()
    spans = secrets.scan(line * 20_000)
    assert time.time() - began < 5
    assert collections.Counter(s.kind for s in spans) == {"assign": 20_000, "literal": 20_000}


def test_spans_beyond_the_base_ones_equal_a_plain_lexer():
    """A small grammar, name = "literal" or name = other name on lines of their own, lexed anew by splitting lines."""
    from weftline.llm import secrets

    r = random.Random(6)
    names, letters = ["passphrase", "db_passwd2", "colour", "signing_key", "alias", "other", "auth_token2"], "abcXYZ0123456789-_"
    told = 0
    for _ in range(300):
        lines, known, want, at = [], {}, set(), 0
        for _ in range(r.randrange(1, 12)):
            name = r.choice(names)
            quoted = r.random() < 0.6 or not known
            value = "".join(r.choice(letters) for _ in range(r.randrange(3, 24))) if quoted else r.choice(sorted(known))
            line = f'{name} = "{value}"' if quoted else f"{name} = {value}"
            span = (at + len(name) + 4, at + len(name) + 4 + len(value), value) if quoted else None
            held = [span] if quoted else known[value]
            known[name] = held
            if (score := secrets.name_score(name)) >= 2:
                want |= {(a, b) for a, b, v in held if score + secrets.literal_score(v, True) >= secrets.LEAST_SCORE}
            lines.append(line)
            at += len(line) + 1
        text = "\n".join(lines)
        base = secrets.base_spans(text)
        want = {(a, b) for a, b in want if not any(s.start <= a and b <= s.end for s in base)}
        got = {(s.start, s.end) for s in secrets.scan(text) if s.kind == "literal"}
        assert got == want, text
        told += len(want)
    assert told > 200
