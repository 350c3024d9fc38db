"""The corpus operators against brute force, round trips and held-out accuracy, with the odd rows that each must stand."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tracklens.llm")
from tracklens.llm import bpe, fingerprint, langid, neardup, packing, sharding, tokenfile, topk, toxicity, urls  # noqa: E402
from tracklens.llm.common import Scratch, fresh_dir  # noqa: E402

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "\n\n  x", "don't 'LL they've", "x<|endoftext|>y  <|startoftext|>", "aaaaaaa" * 40, "日本語 テスト 123 ½", "a\tb \r\n c", "\U0001f600 ok", "ΣΑΣ İ", "e\u0301 é"]
SCHEMA = "doc_id bigint, text string, ids string, component_id int, shard int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(ODD)] + [(3, "a", "x", 1, 2), (None, "null key", None, None, None), (99, "word " * 60_000, "x", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 2, 4, 5: tokens ------------------------------------------------------------------------------------------


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids, t


def test_bpe_equals_the_library_and_comes_back(spark, odd):
    ids_of, lib = library(BYTES)
    out = bpe.decode(bpe.encode(odd, BYTES), BYTES).collect()
    assert len(out) == odd.count()
    for r in out:
        assert list(r.ids) == ids_of(r.text)
        assert r.decoded == lib.decode(ids_of(r.text), skip_special_tokens=False) == (r.text or "")
    assert bpe.encode(empty(spark), BYTES).count() == 0


def test_both_vocabularies_on_random_text():
    rng = random.Random(5)
    marks = [chr(c) for c in [*range(0x20, 0x17F), 0x3A3, 0x430, 0x300, 0x2003, 0x4E00, 0x1F600]] + [" ", "\n", "a", "b", "'s"] * 20
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 60))) for _ in range(3000)]
    for path in (BYTES, WORDS):
        own, (ids_of, _) = bpe.Encoder(open(path, "rb").read()), library(path)
        flat, at = own.encode(texts)
        for i, t in enumerate(texts):
            assert flat[at[i] : at[i + 1]].tolist() == ids_of(t), repr(t)


def test_newer_letters_equal_the_library():
    ids_of, _ = library(WORDS)
    own = bpe.Encoder(open(WORDS, "rb").read())
    texts = ["ab" + "".join(map(chr, range(a, a + 40))) + " cd" for a in range(0x80, 0x32000, 40) if not 0xD7D0 <= a < 0xE000]
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    flat, at = own.encode([*texts, "plain", ""])
    assert all(flat[at[i] : at[i + 1]].tolist() == ids_of(t) for i, t in enumerate([*texts, "plain", ""]))


def test_one_place_for_each_different_unit_of_a_pass(monkeypatch):
    """However often a word stands in a pass, it is looked up once; plain texts, apostrophes and odd white space keep their order."""
    texts = ["the cat sat on the mat " * 2000 + "end", "", "don't o'clock, 'tis rock'n'roll\nthe dogs' 's 12'34", "'", "x  \ty's ", "Ünder 日本's", "a<|endoftext|>b's"]
    for path in (BYTES, WORDS):
        own, (ids_of, _) = bpe.Encoder(open(path, "rb").read()), library(path)
        asked = []
        index_in = bpe.pc.index_in
        monkeypatch.setattr(bpe.pc, "index_in", lambda units, asked=asked, index_in=index_in, **more: asked.append(len(units)) or index_in(units, **more))
        for some in (texts, texts[:1], texts[-1:], [], [""]):
            flat, at = own.encode(some)
            assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ids_of(t) for t in some]
        monkeypatch.undo()
        assert len(asked) == 5 and asked[0] < 60 and asked[1] <= 7


def test_token_files(spark, odd):
    ids_of, _ = library(WORDS)
    where = fresh_dir(spark, "tokens")
    got = tokenfile.read(tokenfile.write(odd, WORDS, where)).collect()
    assert sorted(r.start for r in got) == [r.start for r in sorted(got, key=lambda r: (r.start))]
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted(r.doc_id for r in odd.collect() if r.doc_id is not None)]
    text = {r.doc_id: r.text for r in odd.collect()}
    at = 0
    for r in got:
        ids = [*ids_of(text[r.doc_id]), 2]
        assert (r.start, r.n_tokens) == (at, len(ids)) and np.frombuffer(r.tokens, "<u4").tolist() == ids
        at += len(ids)
    assert tokenfile.read(tokenfile.read_manifest(spark, where)).count() == len(got)
    one = tokenfile.read_manifest(spark, where).orderBy("first").first()
    reader = tokenfile.Reader(one.file)
    assert reader.document(0).tolist() == np.frombuffer(got[0].tokens, "<u4").tolist()
    assert tokenfile.read(tokenfile.write(empty(spark), WORDS, fresh_dir(spark, "none"))).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 3), (1000, 10**12), (3000, 100), (700, 700)):
        v = np.sort(rng.integers(0, top, n))
        e = tokenfile.EliasFano.from_bytes(tokenfile.EliasFano.of(v).to_bytes())
        assert e.values().tolist() == v.tolist()
        assert [e.select(i) for i in range(0, n, 7)] == v[::7].tolist()
    assert tokenfile.EliasFano.of([]).values().tolist() == []


def test_packing(spark, odd):
    ids_of, _ = library(BYTES)
    rows = packing.pack(odd, BYTES).collect()
    whole = {r.doc_id: [*ids_of(r.text), 0] for r in odd.collect()}
    seen = defaultdict(int)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        ids = whole[r.doc_id]
        assert np.frombuffer(r.tokens, "<u4").tolist() == ids[r.start : r.start + r.length]
        assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.length == 1 << r.bucket and r.doc_tokens == len(ids) and r.offset == 0
        seen[r.doc_id] += r.length
    assert all(seen[k] == len(v) * (2 if k == 3 else 1) for k, v in whole.items())
    assert packing.pack(empty(spark), BYTES).count() == 0
    with pytest.raises(ValueError):
        packing.piece_lengths(np.array([3]), 1000)


# -- 1: near duplicates -----------------------------------------------------------------------------------------


def word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts, hundred):
    sets = {k: word_set(t) for k, t in texts.items()}
    up = {k: k for k in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= hundred * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}, {k: len(s) for k, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, k = {}, 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(40, 120))
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[k], k = " ".join(w), k + 1
    hot = rng.choices(vocabulary, k=100)
    texts[k], k = " ".join(hot), k + 1
    for _ in range(60):  # a dense group around one text, larger than a node is allowed to be below
        w = list(hot)
        w[rng.randrange(100)] = rng.choice(vocabulary)
        texts[k], k = " ".join(w), k + 1
    texts |= {k: "", k + 1: None, k + 2: "One TWO", k + 3: "one two", k + 4: "\x0b"}
    for node, cluster in ((256, 512), (16, 20)):
        monkeypatch.setattr(neardup, "NODE", node)
        monkeypatch.setattr(neardup, "CLUSTER", cluster)
        df = spark.createDataFrame([(a, b, 0) for a, b in texts.items()], "doc_id bigint, text string, n int")
        got = {r.doc_id: r for r in neardup.near_duplicates(df, hundred=85).collect()}
        component, size = brute(texts, 85)
        assert {a: (r.component_id, r.n_shingles) for a, r in got.items()} == {a: (component[a], size[a]) for a in texts}
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_odd_rows(spark, odd):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, None)]
    assert neardup.near_duplicates(empty(spark)).count() == 0


def near_copies(rng, words, at):
    w = list(words)
    for i in at:
        w[i] = f"e{rng.randrange(10**9)}"
    return w


def test_near_duplicates_dense_group_hangs_on_its_largest_id(spark):
    rng = random.Random(21)
    base = [f"b{i}" for i in range(600)]
    rows = [(i, " ".join(near_copies(rng, base, [rng.randrange(100 * k + 5, 100 * k + 95) for k in range(6)]))) for i in range(1500)]
    assert len(word_set(rows[0][1]) & word_set(rows[1][1])) < 0.85 * len(word_set(rows[0][1]) | word_set(rows[1][1]))
    df = spark.createDataFrame([*rows, (9999, " ".join(base))], "doc_id bigint, text string")
    got = neardup.near_duplicates(df, hundred=85).collect()
    assert len(got) == 1501 and {r.component_id for r in got} == {0}


def test_near_duplicates_of_a_template_keep_every_link(spark):
    rng = random.Random(24)
    base = [f"b{i}" for i in range(400)]
    rows = [(i, near_copies(rng, base, sorted(rng.sample(range(5, 395, 12), 5)))) for i in range(900)]
    assert len(word_set(" ".join(rows[0][1])) & word_set(" ".join(rows[1][1]))) < 0.8 * len(word_set(" ".join(rows[0][1])) | word_set(" ".join(rows[1][1])))
    rows += [(5000 + i, near_copies(rng, rows[7 * i][1], [rng.randrange(5, 395)])) for i in range(100)]
    texts = {k: " ".join(w) for k, w in rows}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame([*texts.items()], "doc_id bigint, text string"), hundred=85).collect()}
    sets = {k: word_set(t) for k, t in texts.items()}
    pairs = [(7 * i, 5000 + i) for i in range(100)]
    assert all(100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for a, b in pairs)
    assert all(got[a] == got[b] for a, b in pairs) and got == brute(texts, 85)[0]


def test_components(spark):
    rng = random.Random(25)
    edges = [(i, i + 1) for i in range(50)] + [(200, 200 + i) for i in range(1, 60)] + [(300 + i, 400) for i in range(40)] + [tuple(sorted(rng.sample(range(1000, 1200), 2))) for _ in range(150)]
    def found(edges):
        work = Scratch(spark, "test")
        out = {r.id: r.c for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint"), work).collect()}
        work.clear()
        return out

    assert found(edges) == classes(edges, {k for e in edges for k in e})
    assert found([]) == {}


def test_components_of_long_chains(spark, monkeypatch):
    """Rounds grow with the logarithm of a chain's length, whatever the order of its ids."""
    monkeypatch.setattr(neardup, "ROUNDS", 14)
    n = 1000
    two = [(i, i + k) for i in range(n) for k in (1, 2)]
    shuffled = random.Random(4).sample(range(5000, 5000 + n + 2), n + 2)
    windows = [(7000 + i, 7000 + i + k) for i in range(n) for k in range(1, 6)]
    for edges in (two, [tuple(sorted((shuffled[a], shuffled[b]))) for a, b in two], windows):
        work = Scratch(spark, "test")
        got = neardup.components(spark.createDataFrame(edges, "a bigint, b bigint"), work).collect()
        least = min(a for a, _ in edges)
        assert {r.id for r in got} == {k for e in edges for k in e} and all(r.c == least for r in got) and len(got) == len({r.id for r in got})
        work.clear()
    monkeypatch.setattr(neardup, "ROUNDS", 2)
    with pytest.raises(RuntimeError):
        neardup.components(spark.createDataFrame(two, "a bigint, b bigint"), Scratch(spark, "test"))


def hot_passage(rng, pairs, shared, own, edits):
    """Texts that share a passage, each with a copy edited in its own part."""
    passage, rows = [f"s{i}" for i in range(shared)], []
    for i in range(pairs):
        w = passage + [f"o{rng.randrange(10**9)}" for _ in range(own)]
        at = [shared + 5 + (own - 10) // edits * e for e in range(edits)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(near_copies(rng, w, at)))]
    return rows


def share_found(spark, rows, hundred):
    sets = {k: word_set(t) for k, t in rows}
    assert all(100 * len(sets[k] & sets[k + 1]) >= hundred * len(sets[k] | sets[k + 1]) for k in range(0, len(rows), 2))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), hundred=hundred).collect()
    found = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(rows) and all(c in (k, k - k % 2) for k, c in found.items())
    return sum(found[k + 1] == k for k in range(0, len(rows), 2)) / (len(rows) // 2)


def test_near_duplicates_with_a_shared_passage(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", 16)
    assert share_found(spark, hot_passage(random.Random(22), 400, 150, 50, 2), 85) == 1  # three quarters shared


def test_near_duplicates_recall_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", 4)
    assert share_found(spark, hot_passage(random.Random(23), 600, 100, 100, 3), 85) >= 0.995  # similarity 0.858


def test_branching_keeps_threshold_pairs_at_depth_10(spark):
    x = np.arange(neardup.COORDINATES, dtype=np.uint16)
    pairs = 600
    rows = []
    for i in range(pairs):
        y = x.copy()
        y[np.random.default_rng(i).permutation(neardup.COORDINATES)[:19]] += 1000  # 109 of 128 agree
        rows += [(i, 2 * i, x.tobytes(), b"\0\1"), (i, 2 * i + 1, y.tobytes(), b"\0\1")]
    for depth in range(10):
        met = defaultdict(set)
        made = neardup.branch(spark.createDataFrame(rows, "node bigint, id bigint, sig binary, path binary"), 0.85, depth).collect()
        for r in made:
            met[r.node, r.id // 2].add(r.id)
        rows = [tuple(r) for r in made if len(met[r.node, r.id // 2]) == 2]
    assert len({r[1] for r in rows}) / 2 >= 0.8 * pairs  # a critical process keeps 0.44


def test_branching_never_reuses_a_coordinate(spark):
    sig = np.arange(neardup.COORDINATES, dtype=np.uint16)
    rows = [(n, n, sig.tobytes(), bytes(range(n, n + 100))) for n in range(20)]
    members = spark.createDataFrame(rows, "node bigint, id bigint, sig binary, path binary")
    got = neardup.branch(members, 0.85, 1).collect()
    assert {r.id for r in got} == set(range(20)) and all(len(set(r.path)) == 101 for r in got)


# -- 3: top-k ---------------------------------------------------------------------------------------------------


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 16)).round(2)
    v[300:340] = v[0]  # ties
    rows = [(i, x.tolist(), i) for i, x in enumerate(v)] + [(9000, None, 0), (9050, [1.0, None] * 8, 0), (9100, [float("nan")] * 16, 0), (9150, [float("inf")] * 16, 0), (None, [1.0] * 16, 0), (9200, [], 0), (9250, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int").repartition(5)
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, shard=150, block=8).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    q = np.floor(256 * np.float32(v).astype(np.float64)).astype(np.int64)
    for i in range(0, 700, 50):
        s = q @ q[i]
        best = sorted((-s[j], j) for j in range(700) if j != i)[:5]
        assert sorted(got[i]) == [(k + 1, j, -x) for k, (x, j) in enumerate(best)]
    assert set(got) == set(range(0, 700, 50))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    rows = sorted((r["rank"], r.vec_id) for r in topk.top_k(twice, F.col("vec_id") == 0).collect())
    assert rows == [(1, 1), (2, 1), (3, 2), (4, 2)]  # a repeated row counts once for each copy


# -- 6, 7: classifiers --------------------------------------------------------------------------------------------


def test_toxicity_finds_gapped_and_inserted_insults(spark):
    rng = random.Random(4)
    clean = [" ".join("".join(rng.choices([a + b for a in "tlmrsndkp" for b in "aoieu"], k=rng.randint(2, 5))) for _ in range(30)) for _ in range(400)]
    bad = ["blorgle", "zivvex"]
    docs, labels = [], []
    for i, t in enumerate(clean):
        y = int(i % 4 == 0)
        docs.append((i, t + (f" {rng.choice(bad)} " if y else " ") + rng.choice(clean).split()[0]))
        labels.append((i, y, 1))
    df, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*labels, (None, 1, 1), (7777, 1, 1), (3, None, 1)], "doc_id bigint, toxic int, quality int")
    model = toxicity.fit(df, lab, F.col("doc_id") % 5 != 0)
    probe = spark.createDataFrame([(0, "talo blorgle mi"), (1, "talo b-l-o-r-g-l-e mi"), (2, "talo b l o r g l e mi"), (3, "ta blorxgle lo"), (4, "ta zivvexing lo"), (5, "talo mire sunalo"), (6, None), (7, ""), (8, "!!! 123")], "doc_id int, text string")
    p = {r.doc_id: r.toxic_score for r in toxicity.score(probe, model).collect()}
    assert min(p[k] for k in range(5)) >= toxicity.THRESHOLD > max(p[k] for k in range(5, 9))
    held = toxicity.score(df, model).where("doc_id % 5 = 0").join(lab, "doc_id").collect()
    assert sum((r.toxic_score >= toxicity.THRESHOLD) == bool(r.toxic) for r in held) >= 0.95 * len(held)
    nothing = toxicity.fit(df, lab.limit(0), F.lit(True))
    assert toxicity.score(df, nothing).where("toxic_score between 0 and 1").count() == len(docs)


def naive_kernel(x, y):
    def features(s):
        out = defaultdict(float)
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    for m in range(k + 1, min(len(s), i + toxicity.SPAN)):
                        out[s[i] + s[j] + s[k] + s[m]] += toxicity.DECAY ** (m - i - toxicity.ORDER + 1)
        return out

    a, b = features(x), features(y)
    both = sum(v * b.get(k, 0.0) for k, v in a.items())
    return both / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5 if a and b else 0.0


def test_toxicity_kernel_equals_a_naive_one():
    rng = random.Random(16)
    marks = toxicity.Landmarks(["^blorgle$", "zivv", "^ab", "orgl"])
    words = ["blorgle", "blorxgle", "zivvexing", "abcd", "a", "", "orglorgl"] + ["".join(rng.choices("abglorzivx", k=rng.randint(1, 20))) for _ in range(80)]
    got = marks.kernel(words)
    for w, row in zip(words, got, strict=True):
        want = [naive_kernel(toxicity.START + w + toxicity.END, m) for m in marks.strings]
        assert np.allclose(row, [v if v >= toxicity.FLOOR else 0.0 for v in want], atol=1e-9), w
    long = "blorgle" * 9  # read in windows: as similar as the most similar one
    assert np.allclose(marks.kernel([long])[0], [max(naive_kernel(v, m) for v in toxicity.windows(long)) if max(naive_kernel(v, m) for v in toxicity.windows(long)) >= toxicity.FLOOR else 0.0 for m in marks.strings])


def test_toxicity_odd_rows(spark):
    docs = [(i, ("zurgle " if i % 3 == 0 else "") + f"plain w{'abcdefghij'[i % 10]} text") for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = toxicity.fit(df, df.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")), F.lit(True))
    odd = spark.createDataFrame([(1, "zurgle", 5.0), (1, "zurgle", 5.0), (2, None, None), (3, "", 1.0), (4, "word " * 200_000 + "zurgle", 1.0), (None, "plain", 1.0)], "doc_id bigint, text string, toxic_score double")
    got = toxicity.score(odd, model).collect()
    assert len(got) == 6 and [c for c in toxicity.score(odd, model).columns] == ["doc_id", "text", "toxic_score"]
    p = [r.toxic_score for r in got if r.doc_id == 1]
    assert p[0] == p[1] >= toxicity.THRESHOLD and [r.toxic_score >= toxicity.THRESHOLD for r in sorted((r for r in got if (r.doc_id or 0) > 1), key=lambda r: r.doc_id)] == [False, False, True]
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_language_kernel_equals_brute_force():
    texts = ["the cat and the hat", "der hund und das haus", "le chat et la table", "The CAT; and the dog!", "x"]
    rows, _ = langid.presence(texts)

    def grams(text):
        t = "".join(c if c.isalpha() else " " for c in text.lower() + " ")
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            both = int((rows[i].astype(bool) & rows[j].astype(bool)).sum())
            assert abs(both - len(grams(a) & grams(b))) <= 1  # but for hashes that coincide
    model = langid.Model(["de", "en", "fr"], rows[:3], np.array([1, 0, 2]), 1, 1e-2)
    k = lambda a, b: (a.astype(bool) & b.astype(bool)).sum() / np.sqrt(a.sum(dtype=int) * b.sum(dtype=int))
    assert np.allclose(model._similar(rows), [[k(r, rows[m]) for m in (1, 0, 2)] for r in rows])
    assert model.predict(texts[:4])[0] == ["en", "de", "fr", "en"]


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs, langid.remainder(F.col("doc_id"), 5) != 0)
    got = langid.predict(docs, model).where(langid.remainder(F.col("doc_id"), 5) == 0).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)
    odd = spark.createDataFrame([(None, "x"), ("", "x"), ("123 !?", "x"), ("the and of " * 50_000, None)], "text string, lang_pred string")
    rows = langid.predict(odd, model).collect()
    assert [r.lang_pred for r in rows if len(r.text or "") < 10] == ["und"] * 3 and all(0 <= r.lang_score <= 1 for r in rows)
    none = langid.fit(docs, F.lit(False))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


# -- 8, 9: shards and urls ------------------------------------------------------------------------------------------


def test_shards(spark, odd):
    got = sorted((r for r in sharding.sharded_documents(odd, 3).collect()), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in got] == [None, *sorted(r.doc_id for r in odd.collect() if r.doc_id is not None)]
    total = sum(r.size for r in got)
    before = 0
    for r in got:
        assert r.shard == before * 3 // total
        before += r.size
    for s in range(3):
        assert [r.slot for r in got if r.shard == s] == list(range(sum(r.shard == s for r in got)))
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 8 for r in got)
    assert sharding.sharded_documents(empty(spark)).count() == 0


def test_url_rules_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    hosts = ["com", "example.com", "www.example.com", "EXAMPLE.com", "badexample.com", "a.b.www.example.com", "x.net", "net", "", "example.com."]
    paths = ["", "/", "/en/", "/en/1?q=/es/", "/es/#x", "/fr", "/fr/2", "/EN/"]
    pages = [(i, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(paths)}", "h") for i in range(400)] + [(900, None, "h"), (901, "no scheme/en/", "h"), (902, "a://b://c/en/", "h"), (None, "http://x.net/es/", "h"), (5, "http://net/es/", "h")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, host string")

    def judge(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    assert urls.judge_urls(df.limit(0), urls.rules_table(spark)).count() == 0
    pages.append((950, "http://example.com/en/" + "x" * 300_000, "h"))
    df = spark.createDataFrame(pages, "page_id bigint, url string, host string")
    for most, literal in ((urls.BROADCAST_RULES, urls.LITERAL_WORDS), (1, 1)):
        monkeypatch.setattr(urls, "BROADCAST_RULES", most)
        monkeypatch.setattr(urls, "LITERAL_WORDS", literal)
        got = urls.judge_urls(df, urls.rules_table(spark)).collect()
        assert len(got) == len(pages)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == judge(r.url), r
    assert urls.judge_urls(df, urls.rules_table(spark).limit(0)).where("verdict = 'allow' and rule is null").count() == len(pages)


# -- 10: fingerprints -----------------------------------------------------------------------------------------------


def test_fingerprints(spark, odd):
    got = fingerprint.compare_edited(odd).collect()
    order = sorted(((-(1 << 63) if r.doc_id is None else r.doc_id), r.text or "", r.doc_id) for r in odd.collect())
    assert len(got) == len(order)
    want = defaultdict(set)
    for i, (_, text, key) in enumerate(order):
        want[key].add((len(text), hashlib.sha256(fingerprint.edited(text, order[i - 1][1]).encode()).hexdigest()))
    for r in got:
        assert (r.n_chars, r.edited_sha256) in want[r.doc_id] and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprint.compare_edited(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "alone here")], "doc_id bigint, text string")
    assert fingerprint.compare_edited(one).first().near_next == 1.0


def test_likeness_follows_edits():
    rng = random.Random(8)
    base = "".join(rng.choices("abcdefgh ", k=3000))
    few = base[:700] + "x" + base[700:1500] + base[1503:]
    other = "".join(rng.choices("abcdefgh ", k=3000))
    a, b, c, d = fingerprint.fingerprints([base, few, other, base])
    assert a == d and fingerprint.likeness(a, b) > 0.7 > 0.2 > fingerprint.likeness(a, c)


def test_likeness_follows_an_insertion_at_the_start():
    rng = random.Random(10)
    texts = ["".join(rng.choices("abcdefgh ", k=100_000)) for _ in range(8)]
    longer = [t[:50] + "".join(rng.choices("abcdefgh ", k=60)) + t[50:] for t in texts]
    made = fingerprint.fingerprints([*texts, *longer])
    assert sum(map(fingerprint.likeness, made[:8], made[8:])) / 8 > 0.4  # 0.59; walks that start anew every 1,024 characters give 0.06


def test_walks_together_equal_walks_alone():
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdefgh \u65e5\U0001f600", k=rng.choice([0, 1, 3, 700, 1500, 2600]))) for _ in range(120)]
    assert fingerprint.fingerprints(texts) == [fingerprint.fingerprints([t])[0] for t in texts]


def naive_walk(text):
    """The symbols at each step of a text's walk, character by character."""
    p, out = 0, []
    for j in range(2 * len(text)):
        symbol = ord(text[p]) if p < len(text) else fingerprint.PAST
        out.append(symbol)
        x = (symbol * 0x9E3779B1 + j * 0x85EBCA77 + fingerprint.SEED) % 2**32
        x = ((x ^ (x >> 16)) * 0x7FEB352D) % 2**32
        x = ((x ^ (x >> 15)) * 0x846CA68B) % 2**32
        p += (x ^ (x >> 16)) >> 31 if p < len(text) else 1
    return out


def naive_digit(symbol):
    x = ((symbol ^ (symbol >> 16)) * 0x7FEB352D) % 2**32
    x = ((x ^ (x >> 15)) * 0x846CA68B) % 2**32
    return "0123456789abcdef"[(x ^ (x >> 16)) & 15]


def test_fingerprints_equal_a_naive_walk():
    rng = random.Random(13)
    texts = ["", "a", "ab", "aaaaaaaaaaaaaaaaaaaaa", "\u65e5\U0001f600"] + ["".join(rng.choices("abcdefgh \u65e5", k=rng.randint(1, 1500))) for _ in range(60)]
    for text, made in zip(texts, fingerprint.fingerprints(texts), strict=True):
        walk = naive_walk(text)
        steps = np.concatenate([fingerprint.octave_steps(o) for o in range(len(made) // fingerprint.SAMPLES)] or [np.zeros(0, int)])
        assert made == "".join(naive_digit(walk[j]) if j < len(walk) else "-" for j in steps.tolist()), text


def test_fingerprint_pairs(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefghijklmnop ", k=800)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t[:400] + "zz" + t[402:]) for i, t in enumerate(texts)] + [(500, ""), (501, None), (None, texts[0])]
    # the walks of two of the pairs stay out of step for long: their likeness is 0.43 and 0.48, all others' 0.58 or more
    got = fingerprint.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), least=0.4).collect()
    assert len(got) == len(rows) and [r.class_id for r in got if r.doc_id is None] == [None]
    assert {(r.class_id, r.doc_id) for r in got if r.doc_id is not None and r.doc_id != r.class_id} == {(i, 100 + i) for i in range(30)}
    assert fingerprint.near_duplicates(empty(spark)).count() == 0


def classes(pairs, keys):
    up = {k: k for k in keys}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def wanted_classes(rows, least=0.8):
    made = dict(zip([k for k, _ in rows], fingerprint.fingerprints([t for _, t in rows]), strict=True))
    pairs = [(a, b) for a in made for b in made if a < b and fingerprint.likeness(made[a], made[b]) >= least]
    return classes(pairs, made), pairs


def test_fingerprint_recall_at_all_lengths(spark):
    rng = random.Random(14)
    rows, k = [], 0
    for n in (30, 300, 1000, 1030, 5000):
        for _ in range(25):
            t = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
            at = rng.randrange(n)
            rows += [(k, t), (k + 1, t[:at] + rng.choice("abcdefgh") + t[at:])]
            k += 2
    want, pairs = wanted_classes(rows)
    got = {r.doc_id: r.class_id for r in fingerprint.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(pairs) >= 90 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(want[k] == c or want[k] < c for k, c in got.items())  # nothing is linked that isn't alike


def test_fingerprint_classes_across_lengths_and_in_one_bucket(spark, monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choices("abcdefghijklmnop ", k=1020)) for _ in range(10)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + "tenletters") for i, t in enumerate(texts)] + [(200 + i, t[:1000] + "other end") for i, t in enumerate(texts)]
    base = "".join(rng.choices("abcdefghijklmnop ", k=900))
    for i in range(90):  # copies of one text, edited near its end, more than a bucket's pairs, and others with its opening
        rows.append((300 + i, base[: 890 - i % 9] + "".join(rng.choices("xyz", k=10))))
        rows.append((500 + i, base[:450] + "".join(rng.choices("abcdefghijklmnop ", k=450))))
    want, pairs = wanted_classes(rows)
    for bucket, part in ((64, 512), (8, 16)):
        monkeypatch.setattr(fingerprint, "BUCKET", bucket)
        monkeypatch.setattr(fingerprint, "PART", part)
        got = {r.doc_id: r.class_id for r in fingerprint.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert len(pairs) >= 200 and got == want


# -- the pipeline -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with odd rows and columns named as helpers, its labels, and the folder of both."""
    rng = random.Random(31)
    letters = {"en": "theandofingtoershall", "de": "derundschichtkeitlich"}
    say = lambda k, n: " ".join("".join(rng.choices(letters[k], k=rng.randint(3, 8))) for _ in range(n))
    rows = [(i, say("en" if i % 2 else "de", 40) + (" blorgle." if i % 7 == 0 else "."), "en" if i % 2 else "de") for i in range(420)]
    labels = [(i, int(i % 7 == 0)) for i in range(420) if i % 5]
    copy = rows[3][1]
    rows += [(1000, copy, "en"), (1001, copy + " more", "en"), (1000, copy, "en"), (1002, None, None), (1003, "", "de"), (1004, "12 34", None), (1005, "\u65e5\u672c\u8a9e\u30c6\u30b9\u30c8", None), (None, say("en", 30), "en"), (1006, say("de", 40_000), "de")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, lang string, own int, rows int, toxic_score int")
    docs.repartition(3).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(folder + "/labels.parquet")
    return folder


def test_pipeline_stages(spark, corpus):
    import corpus_pipeline as cp

    docs = spark.read.parquet(corpus + "/documents.parquet")
    spoken = cp.language(spark, docs, corpus)
    assert spoken.columns == docs.columns
    model = langid.fit(docs, langid.remainder(F.col("doc_id"), 5) != 0)
    text = {r.doc_id: r.text for r in docs.collect()}
    names, scores, known = model.predict([t or "" for t in text.values()])
    stay = {k for k, n, s, w in zip(text, names, scores, known, strict=True) if n != "und" and s >= cp.LANGUAGE_FROM and w >= cp.KNOWN_FROM}
    kept = spoken.collect()
    assert {r.doc_id for r in kept} == stay and stay >= {*range(420), 1000, 1001, 1006, None} and not stay & {1002, 1003, 1004, 1005}

    calm = cp.mild(spark, docs, corpus)
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in calm.collect()}
    assert calm.columns == docs.columns and gone == {i for i in range(420) if i % 7 == 0}

    once = cp.distinct_documents(spark, docs, corpus)
    component, _ = brute({k: t for k, t in text.items() if k is not None}, 80)
    assert sorted(str(r.doc_id) for r in once.collect()) == sorted(str(k) for k in text if k is None or component[k] == k)
    assert once.columns == docs.columns and not {1000, 1001} & {r.doc_id for r in once.collect()}

    ids_of, _ = library(BYTES)
    packed = defaultdict(int)
    for r in cp.packed(spark, docs, corpus).collect():
        packed[r.doc_id] += r.length
    count = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert packed == {k: (len(ids_of(t)) + 1) * count[k] for k, t in text.items()}


def test_pipeline_on_nothing_and_whole(spark, corpus):
    import corpus_pipeline as cp

    docs = spark.read.parquet(corpus + "/documents.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), corpus).count() == 0
    left = docs
    for _, stage in cp.STAGES[:-1]:
        left = stage(spark, left, corpus)
    assert {r.doc_id for r in cp.run(spark, corpus).select("doc_id").distinct().collect()} == {r.doc_id for r in left.collect()}
