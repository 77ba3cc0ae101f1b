import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.operators import evaluate as E
from corpusloom.operators import generate as Y
from corpusloom.operators import retrieval as R
from corpusloom.operators import runs as U
from corpusloom.operators import tokenizer as K
from corpusloom.operators import training as N
from corpusloom.sources import config
from corpusloom.sources import readers as S
from corpusloom.streaming import streams


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["a\r\nb\rc\n", "", "\n", "a\n\nb", "x\x0by\x0cz\x1cq\x85r s t", "no end"])
def test_lines_and_words_are_pythons(spark, text):
    assert one(spark, text, T.lines) == text.splitlines()
    assert one(spark, text, T.words) == text.split()
    assert "".join(one(spark, text, T.pieces)) == text


def test_normalised(spark):
    assert one(spark, "hello\nworld   test", T.normalised) == "hello\nworld test"
    assert one(spark, "  a\t b\r\n\n\n\nc ", T.normalised) == "a b\n\nc"


def test_repetition(spark):
    assert one(spark, "a b c d a b c d", T.repetition) == 0.2
    assert one(spark, "a b c", T.repetition) == 0.0


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_split(spark):
    ten = C.split_lines(docs(spark, ["\n".join(f"line {i}" for i in range(10)) + "\nline 3"]))
    assert {r["split"]: r["count"] for r in ten.groupBy("split").count().collect()} == {"train": 9, "test": 1}
    assert [r["split"] for r in C.split_lines(docs(spark, ["one"])).collect()] == ["train"]
    assert C.split_lines(docs(spark, [None, ""])).count() == 0
    with pytest.raises(ValueError, match="sum to"):
        C.check_ratios(0.5, 0.3, 0.3)


def test_chunks_and_targets(spark):
    ids = spark.createDataFrame([(1, list(range(10))), (2, [])], "doc_id long, ids array<int>")
    assert [len(r["tokens"]) for r in C.token_chunks(ids, 4).orderBy("chunk_no").collect()] == [4, 4, 2]
    with pytest.raises(ValueError):
        C.token_chunks(ids, 4, 4)
    row = C.next_targets(spark.createDataFrame([([5, 6, 7],)], "tokens array<int>"), 5).first()
    assert (row["input"], row["target"]) == ([5, 6, 7, 0, 0], [6, 7, 0, -100, -100])
    d = docs(spark, ["a b c d e"])
    assert [r["text"] for r in R.chunks(d, 3, 1).orderBy("chunk_no").collect()] == ["a b c", "c d e", "e"]


def test_strided_windows(spark):
    n = spark.createDataFrame([(1, 10)], "k int, n int")
    rows = C.strided_windows(n, "k", "n", 4, 6).orderBy("window_no").collect()
    assert [(r["start"], r["stop"], r["scored"]) for r in rows] == [(0, 6, 5), (4, 10, 3), (8, 10, 0)]
    assert C.strided_windows(n, "k", "n", 4, 6, exact=True).agg(F.sum("scored")).first()[0] == 9


def test_search(spark, tmp_path):
    d = docs(spark, ["machine learning is fun", "cooking is an art", None])
    q = spark.createDataFrame([(1, "machine learning"), (2, "zebra"), (3, "")], "query_id int, query string")
    index = R.Index.of(d)
    rows = index.search(q).collect()
    assert [(r["query_id"], r["doc_id"]) for r in rows] == [(1, 0)]
    dl, avg = 4, 4.0
    assert math.isclose(rows[0]["score"], 2 * math.log((2 - 1 + 0.5) / 1.5 + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avg)))
    index.save(str(tmp_path / "i"))
    assert [r["score"] for r in R.Index.load(spark, str(tmp_path / "i")).search(q).collect()] == [rows[0]["score"]]
    prompts = {r["query_id"]: r["prompt"] for r in R.context_prompts(R.retrieved(index, d, q, 3), q).collect()}
    assert "[1] [Source: 0]: machine learning is fun" in prompts[1] and prompts[2] == "Question: zebra\nAnswer:"
    assert R.Index.of(d.limit(0)).search(q).count() == 0
    wide = R.Index.of(d)
    saved = R.Index(wide.postings, wide.terms, wide.corpus)  # searched by its tables
    assert [tuple(r) for r in saved.search(q).collect()] == [tuple(r) for r in rows]


def test_arrays(spark):
    row = spark.createDataFrame([([0.1, 5.0, 2.0], [1, 7])], "x array<double>, seen array<int>")
    get = lambda c: row.select(c.alias("y")).first()["y"]
    assert get(A.argmax(F.col("x"))) == 1
    assert get(A.softmax(F.col("x"), 0)) == [0.0, 1.0, 0.0]
    assert get(A.penalised(F.col("x"), F.col("seen"), 1.5)) == [0.1, 5.0 / 1.5, 2.0]
    assert [p > 0 for p in get(A.top_k_distribution(F.col("x"), 2))] == [False, True, True]
    assert [r["token"] for r in E.nucleus(row.withColumn("k", F.lit(1)), "k", "x", 0.1).collect()] == [1]
    q = spark.createDataFrame([([-8, 7],)], "q array<int>").select(A.packed_nibbles(F.col("q")).alias("p")).select("p", A.unpacked_nibbles(F.col("p")).alias("q")).first()
    assert (q["p"], q["q"]) == ([0x78], [-8, 7])


def test_runs(spark):
    lr = [round(r["lr"], 6) for r in U.lr_schedule(spark, 1.0, 2, 6).orderBy("step").collect()]
    assert lr == [0, 0.5, 1, 0.853553, 0.5, 0.146447, 0]
    assert math.isclose(U.lr_schedule(spark, 0.1, 5, 50).filter("step = 3").first()["lr"], 0.06)
    assert U.latest(spark.createDataFrame([("step_900",), ("step_1000",)], "path string")).first()["path"] == "step_1000"
    assert U.speedup_grid(spark, 5, 10, 10.0, 1.0).filter("gamma = 5 and rate = 0.7").first()["speedup"] == pytest.approx(3.0)


def plain_bpe(texts, target):
    """The rule in full, recounted for every merge, on lists of latin-1 strings."""
    import regex

    words = [[chr(b) for b in w.encode()] for t in texts for w in regex.findall(r"\s*\S+|\s+", t)]
    vocab, merges = {chr(b) for b in range(256)}, []
    while len(vocab) < target - 4:
        seen = {}
        for w in words:
            for k in range(1, len(w)):
                seen[w[k - 1], w[k]] = seen.get((w[k - 1], w[k]), 0) + 1
        if not seen or max(seen.values()) < 2:
            break
        most = max(seen.values())
        a, b = next(p for p, n in seen.items() if n == most)
        merges.append((a, b))
        vocab.add(a + b)
        for n, w in enumerate(words):
            joined, k = [], 0
            while k < len(w):
                two = k + 1 < len(w) and w[k] == a and w[k + 1] == b
                joined.append(a + b if two else w[k])
                k += 1 + two
            words[n] = joined
    return merges


def plain_encode(tokenizer, word):
    s = [bytes([b]) for b in word.encode()]
    while True:
        ranked = [(tokenizer.ranks[p], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in tokenizer.ranks]
        if not ranked:
            return [tokenizer.ids[x] for x in s]
        i = min(ranked)[1]
        s[i : i + 2] = [s[i] + s[i + 1]]


def test_bpe(spark, tmp_path):
    texts = ["hello world hello there  \n", "the thé 日本語 🙂 the end", "low lower lowest newest widest"] * 3 + ["aaaa abab ababab aaabaaab baba abcabcabc bcabca " * 4]
    d = docs(spark, texts)
    t = K.BytePairs.train(d, 320)
    assert [(a.decode("latin-1"), b.decode("latin-1")) for a, b in t.merges] == plain_bpe(texts, 320)
    assert t.specials == {"<|pad|>": 316, "<|bos|>": 317, "<|eos|>": 318, "<|unk|>": 319}
    assert all(t.decode(t.encode(x)) == x for x in [*texts, "", " unseen\ttext ", "".join(map(chr, range(0x20, 0x500, 37)))])
    assert all(t.piece(w) == plain_encode(t, w) for x in texts for w in [*x.split(), x])
    assert t.decode([999999]) == "<999999>"
    with pytest.raises(ValueError):
        t.decode([999999], strict=True)
    t.save(spark, str(tmp_path / "t"))
    again = K.BytePairs.load(spark, str(tmp_path / "t"))
    assert again.specials == t.specials
    assert again.encode(texts[1]) == t.encode(texts[1]) and again.vocab_size() == 320
    rows = {r["doc_id"]: r["ids"] for r in K.encoded(d, t).collect()}
    assert rows == {i: t.encode(x) for i, x in enumerate(texts)}
    back = K.encoded(d, t).select("doc_id", K.decoded(F.col("ids"), t).alias("text")).collect()
    assert {r["doc_id"]: r["text"] for r in back} == dict(enumerate(texts))


def test_bpe_rules(spark):
    import time

    from corpusloom.plans import registry

    with pytest.raises(ValueError, match="past those of bytes"):
        K.BytePairs([], 300, {"<x>": 3})
    named = K.BytePairs([(b"a", b"b"), (b"ab", b"c"), (b"a", b"bc"), (b"c", b"d")], 300, {"<|end|>": 257, "<z>": 50256})
    assert [named.ids[x] for x in (b"ab", b"abc", b"cd")] == [256, 258, 259] and named.vocab_size() == 50257
    assert named.decode([257, 256, 50256]) == "<|end|>ab<z>" and named.encode("abcd") == [258, 100]
    with pytest.raises(ValueError, match="are needed"):
        K.BytePairs.train(docs(spark, ["short"]))
    words = [("abcd", 9), ("xabc", 5), ("bcd", 4), ("aab", 3), ("abcde", 2), ("qabcdabcd", 2)]
    for vocab in (256, 257, 260, 270, 300):  # by size of the vocabulary: a merge that makes a known string adds nothing to it
        merges = K.learn_merges(words, vocab)
        assert len({a + b for a, b in merges}) == min(vocab - 256, len({a + b for a, b in K.learn_merges(words, 10_000)}))
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    t = K.BytePairs.train(d, 300)
    texts = [r["text"] or "" for r in d.orderBy("doc_id").collect()]
    assert [(a.decode("latin-1"), b.decode("latin-1")) for a, b in t.merges] == plain_bpe(texts, 300)
    long = "".join(w for x in texts[:40] for w in x.split())[:20_000]
    began = time.time()
    ids = t.piece(long)
    assert time.time() - began < 3 and t.decode(ids) == long and t.piece(long[:400]) == plain_encode(t, long[:400])
    assert registry.QUERIES["bpe_train"](spark, sf).count() >= 2048 - 256 - 4


def test_bpe_words_stay_in_tasks(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rows, collect = [], DataFrame.collect

    def counted(self):
        rows.append(len(found := collect(self)))
        return found

    def refused(self, *a, **b):
        raise AssertionError("all words would reach the driver")

    texts = [" ".join(f"w{i * 7919 % 997}x{i}" for i in range(k, k + 40)) + "  aaaa aaa abab\n" for k in range(0, 200, 40)]
    want = plain_bpe(texts, 330)
    monkeypatch.setattr(K, "PART_WORDS", 40)  # several tasks
    monkeypatch.setattr(DataFrame, "collect", counted)
    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    t = K.BytePairs.train(docs(spark, texts), 330)
    assert [(a.decode("latin-1"), b.decode("latin-1")) for a, b in t.merges] == want
    assert max(rows) <= 8  # a row for each task


def test_bpe_roundtrip_as_sql(spark, tmp_path, monkeypatch):
    """Short texts of one id, and longer ones that no merge shortens, are in the query as in its SQL; that ids are fewer than bytes is seen on whole texts."""
    import duckdb
    from corpusloom.plans import registry

    texts = [None, "", " ", "th", "the", "é", "xqzj", "a\0b\0", "\ufeffbom", "\t\n\x0b\x1c\x85\xa0\u2003\u3000", "<|pad|><300>", "\U0001f600 e\u0301 \uffff", "ab" * 500, "the then that thin é " * 40]
    rows = [*enumerate(texts), (None, None), (None, "no id"), (3, "one id twice")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.QUERIES["bpe_roundtrip"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    theirs = con.sql(f"SELECT {', '.join(out.columns)} FROM ({registry.ORACLES['bpe_roundtrip']})").fetchall()
    assert sorted(repr(tuple(r)) for r in out.collect()) == sorted(map(repr, theirs))
    t = K.BytePairs.train(d)
    ids = sorted(map(repr, K.encoded(d, t).select("doc_id", "ids", K.decoded(F.col("ids"), t).alias("text")).collect()))
    monkeypatch.setattr(K, "ROWS", 3)  # several slices of a batch
    assert sorted(map(repr, K.roundtrip(d.coalesce(1), t).collect())) == ids and K.BytePairs.train(d.coalesce(1)).merges == t.merges
    monkeypatch.undo()
    assert t.decode(t.encode("the") * 500_000) == "the" * 500_000  # in time with the length
    assert len(t.encode("the")) < 3 and len(t.encode("xqzj")) == 4
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert K.encoded(d, K.BytePairs.train(d)).join(d, "doc_id").filter(F.size("ids") >= F.octet_length("text")).count() == 0


def test_rounded_as_sql(spark, tmp_path):
    """Small negative numbers round to -0.0 and halves go away from zero, as in DuckDB."""
    import duckdb
    from corpusloom.plans import registry

    v = [-1e-8, 1e-8, -2.5e-7, 0.5, -0.0078125, 2.0000005, -1.0000005, 0.0, -0.0, 1e300, float("inf"), float("-inf")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x double").coalesce(1)
    ours = [repr(r[0]) for r in df.orderBy("i").select(A.rounded(F.col("x"), 6)).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(v)))
    assert ours == [repr(r[0]) for r in con.sql("SELECT round(x, 6) FROM t ORDER BY i").fetchall()] and ours[0] == "-0.0"
    rows = [(i, i % 3, [(-1) ** (i + j) * 10.0 ** -(j % 9) for j in range(64)]) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("causal_attention", "repetition_penalty", "rmsnorm", "rope_rotate", "silu"):
        out = registry.QUERIES[name](spark, str(tmp_path))
        ours = sorted(repr(tuple(r)) for r in out.collect())
        theirs = sorted(repr(tuple(r)) for r in con.sql(f"SELECT {', '.join(out.columns)} FROM ({registry.ORACLES[name]})").fetchall())
        assert ours == theirs and any("-0.0," in x for x in ours), name


def test_search_shuffles_no_scores(spark, monkeypatch):
    """A task passes on the k best of its chunks alone; the same rows as where all scores meet, ties, copies and null doc_ids with them."""
    d = spark.createDataFrame([(None if i == 7 else i, f"common {'rare' if i % 9 == 0 else 'other'} word{i % 5} common") for i in range(120)], "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(1, "common"), (2, "rare common common"), (3, "word1 nothing"), (4, "nothing"), (5, None)], "query_id long, query string")
    of = lambda: sorted(map(repr, R.Index.of(d).search(q, 4).withColumn("score", F.round("score", 9)).select("query_id", "rank", "doc_id", "chunk_no", "score").collect()))
    monkeypatch.setattr(R, "BLOCK", 32)
    monkeypatch.setattr(R.Index, "scores", lambda *_: pytest.fail("all scores would be shuffled"))
    ours = of()
    monkeypatch.undo()
    monkeypatch.setattr(R, "TAKEN_WORDS", 0)
    assert ours == of() and len(ours) == 12


def test_metrics_log_and_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    S.append_metrics(spark.createDataFrame([("header", 3)], "event string, seed int"), path)
    S.append_metrics(spark.createDataFrame([("step", 1, 2.5), ("step", 2, float("nan"))], "event string, step int, loss double"), path)
    assert sorted(r["step"] for r in S.read_metrics(spark, path).collect()) == [1.0, 2.0]
    q = streams.metrics_stream(spark, path).writeStream.format("memory").queryName("m").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("m").count() == 2


def test_stream_ingest(spark, tmp_path):
    docs(spark, ["machine learning", "cooking", ""]).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
        streams.ingest(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination(60)
    q = spark.createDataFrame([(1, "machine")], "query_id int, query string")
    assert [r["doc_id"] for r in streams.grown_index(spark, str(tmp_path / "ix")).search(q).collect()] == [0]


def test_null_keys_are_numbered_as_in_sql(spark, tmp_path):
    import duckdb

    from corpusloom.plans import registry

    docs = [(1, "b\nc\nsame"), (None, "a\nb\nonly here\nsame"), (2, "c\nd")] + [(k, f"line {k}\nmore {k}") for k in range(10, 30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("dedup_lines", "split_train_val_test", "split_leakage", "dataset_manifest"):
        ours = registry.QUERIES[name](spark, str(tmp_path))
        names = ", ".join(f'"{c}"' for c in ours.columns)
        theirs = con.sql(f"SELECT {names} FROM ({registry.ORACLES[name].strip()})").fetchall()
        assert sorted(repr(tuple(r)) for r in ours.collect()) == sorted(map(repr, theirs)) and theirs
    from corpusloom.operators.order import id_cell, numbered

    events = spark.createDataFrame([(5, 1), (None, 2), (3, 3), (None, 4)], "us long, event_id long")
    got = numbered(events, id_cell(events, "us"), ["us", "event_id"], "step", "n").collect()
    assert {(r["event_id"], r["step"], r["n"]) for r in got} == {(3, 0, 4), (1, 1, 4), (2, 2, 4), (4, 3, 4)}


def test_manifest_of_many_documents(spark, tmp_path):
    import hashlib

    d = spark.range(100_000).selectExpr("id AS doc_id", "concat('line ', id) AS text")
    row = C.manifest(d, "many", "1").first()
    assert row["num_documents"] == row["num_lines"] == 100_000
    assert int(row["content_sum"]) == sum(int(hashlib.sha256(f"line {i}".encode()).hexdigest()[:12], 16) for i in range(100_000))
    assert row["train_tokens"] == 180_000 and row["val_tokens"] == row["test_tokens"] == 10_000
    C.save_manifest(C.manifest(d, "many", "1"), str(tmp_path / "m"))
    assert C.load_manifest(spark, str(tmp_path / "m")).first()["content_sum"] == row["content_sum"]
    old = C.legacy_manifest(C.load_manifest(spark, str(tmp_path / "m"))).first()
    assert (old["dataset"], old["num_tokens"], old["tokens_by_split"]["train"]) == ("many", 200_000, 180_000)
    spark.range(1).write.json(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="missing fields"):
        C.load_manifest(spark, str(tmp_path / "bad"))


@pytest.mark.parametrize("ids", ["text", "outlier"])
def test_split_by_odd_ids(spark, ids):
    key = {"text": "lpad(id, 6, 'k')", "outlier": "CASE WHEN id = 5000 THEN 1000000000000000000L ELSE id END"}[ids]
    d = spark.range(5001).selectExpr(f"{key} AS doc_id", "concat('line ', id) AS text")
    rows = C.split_lines(d).orderBy("row_no").collect()
    assert [r["row_no"] for r in rows] == list(range(5001)) and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    from corpusloom.operators.order import id_cell

    sizes = [r["count"] for r in d.select(id_cell(d, "doc_id").alias("c")).groupBy("c").count().collect()]
    assert len(sizes) > 1000 and max(sizes) < 50
    texts = {r["split"]: r["text"].split("\n") for r in C.split_texts(C.split_lines(d)).collect()}
    assert texts["train"] + texts["val"] + texts["test"] == [r["line"] for r in rows]
    assert C.one_split(C.split_lines(d), "val").count() == 250
    with pytest.raises(ValueError, match="no split"):
        C.one_split(d, "dev")


def test_sampler(spark):
    row = spark.createDataFrame([([0.1, 5.0, 2.0, 4.9], [1])], "x array<double>, seen array<int>")
    get = lambda **how: row.select(E.sampler(F.col("x"), **how).alias("y")).first()["y"]
    p = [math.exp(v) for v in (0.1, 5.0, 2.0, 4.9)]
    share = lambda keep: [pytest.approx(v / sum(p[i] for i in keep)) if i in keep else 0 for i, v in enumerate(p)]
    assert get() == share([0, 1, 2, 3])
    assert get(top_p=0.5) == share([1]) and get(top_p=0.6) == share([1, 3]) and get(top_p=1.0) == share([0, 1, 2, 3]) and get(top_p=0.01) == share([1])
    assert get(top_k=1, top_p=0.9) == share([1]) and get(top_k=0, top_p=0.6) == share([1, 3])
    assert get(temperature=0, top_p=0.5) == [0, 1, 0, 0] and get(temperature=0, penalty=2.0, seen=F.col("seen")) == [0, 0, 0, 1]
    for wrong in ({"top_p": 1.5}, {"temperature": -1}, {"penalty": 0.5}, {"penalty": 1.5}):
        with pytest.raises(ValueError):
            get(**wrong)
    draws = row.select(F.lit(1).alias("k"), E.sampler(F.col("x"), top_p=0.6).alias("p"))
    token = lambda u: E.drawn(draws, "k", F.col("p"), F.lit(u)).first()["token"]
    assert (token(0.0), token(0.5), token(0.9), token(0.9999)) == (1, 1, 3, 3)
    assert E.decode_grid(row.select("seen")).count() == 3


def test_ids_out_of_range(spark):
    from pyspark.errors import PySparkException

    seqs = spark.createDataFrame([(1, [0, 2]), (2, []), (3, None)], "k int, ids array<int>")
    table = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "id int, v array<double>")
    assert [(r["k"], r["pos"], r["vec"]) for r in E.embedded(seqs, "k", "ids", table, "id", "v").orderBy("pos").collect()] == [(1, 0, [0.0]), (1, 1, [2.0])]
    assert C.checked_ids(seqs, "ids", 3).count() == 3 and C.checked_ids(seqs, "ids", 3).collect()[0]["ids"] == [0, 2]
    for bad in (E.embedded(seqs, "k", "ids", table.filter("id < 2"), "id", "v"), C.checked_ids(seqs, "ids", 2)):
        with pytest.raises(PySparkException, match="2"):
            bad.collect()


def test_files_and_windows(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"good line\nand \xff bad byte\n")
    (tmp_path / "b.txt").write_bytes(b"x")
    rows = {r["path"].rpartition("/")[2]: r for r in S.text_files(spark, str(tmp_path / "*.txt"), lossy=True).collect()}
    assert rows["a.txt"]["text"] == "good line\nand \ufffd bad byte\n" and len(rows) == 2
    with pytest.raises(Exception, match="UTF"):
        S.text_files(spark, str(tmp_path / "a.txt")).collect()
    import hashlib

    digests = {r["path"].rpartition("/")[2]: r["sha256"] for r in S.file_digests(spark, str(tmp_path / "*.txt")).collect()}
    assert digests["b.txt"] == hashlib.sha256(b"x").hexdigest()
    events = spark.createDataFrame([("2024-01-01 00:00:10", 1.0), ("2024-01-01 00:00:50", 3.0), ("2024-01-01 00:01:10", 5.0)], "t string, v double").select(F.col("t").cast("timestamp").alias("t"), "v")
    got = streams.windowed_loss(events, "t", "v", "1 minute", "1 minute").orderBy("window").collect()
    assert [(r["loss"], r["n"]) for r in got] == [(2.0, 2), (5.0, 1)]


def test_substring_search_brute_force(spark):
    texts = ["Alpha beta", "xalphay\u00a0zed", None, "be a", "ALPHABET soup", "été Été", ""]
    queries = [(1, "alpha"), (2, "no such"), (3, "be a"), (4, "ÉTÉ zed"), (5, "")]
    d, q = docs(spark, texts), spark.createDataFrame(queries, "query_id int, query string")
    for longest in (2, 1):
        want = []
        for i, text in queries:
            words = [w for w in text.lower().split() if len(w) > longest]
            hits = [(i, k) for k, t in enumerate(texts) if any(w in (t or "").lower() for w in words)]
            want += hits or [(i, 0)]
        got = R.substring_search(d, q, longest)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 2  # of one row


def test_running_best(spark):
    from corpusloom.operators import runs

    keep = runs.CELLS
    runs.CELLS = 4
    try:
        loss = [(i, float((i * 7919) % 101) + (200 - i) / 10) for i in range(150)]
        got = U.running_best(spark.createDataFrame(loss, "step long, loss double"), "step", "loss").orderBy("step").collect()
    finally:
        runs.CELLS = keep
    best = float("inf")
    for (_, x), r in zip(loss, got, strict=True):
        best = min(best, x)
        assert r["best"] == best


def test_generation(spark):
    seqs = spark.createDataFrame([([1, 2, 3, 1, 2, 4, 1, 2, 3],), ([5],), (None,)], "ids array<int>")
    model = Y.Bigrams.fit(seqs, "ids", 8)
    assert model([[9, 1], [2]]).argmax(axis=1).tolist() == [2, 3]
    with pytest.raises(Exception, match="out of range"):
        Y.Bigrams.fit(seqs, "ids", 5)
    prompts = spark.createDataFrame([("a", [1]), ("b", [5, 2]), ("c", []), ("d", None)], "k string, ids array<int>")
    get = lambda **how: {r["k"]: (r["ids"], r["stopped"]) for r in Y.generated(prompts, "k", "ids", model, **how).collect()}
    assert get(max_new=4, temperature=0) == {"a": ([2, 3, 1, 2], "length"), "b": ([3, 1, 2, 3], "length"), "c": ([], "empty"), "d": ([], "empty")}
    assert get(max_new=4, temperature=0, stop_id=3)["a"] == ([2, 3], "eos") and get(max_new=9, temperature=0, max_len=3)["b"] == ([3], "max_len")
    text = lambda x: "".join(map(str, x))
    assert get(max_new=9, temperature=0, stops=("31",), decode=text)["a"] == ([2, 3, 1], "stop")
    assert get(max_new=3, temperature=0, penalty=50.0)["a"][0][0] == 2  # the one token that is likely and unseen
    drawn = get(max_new=30, top_k=2)
    assert drawn == get(max_new=30, top_k=2) and drawn != get(max_new=30, top_k=2, seed="1")
    for wrong in ({"max_new": 0}, {"stops": ("x",)}):
        with pytest.raises(ValueError):
            get(**wrong)
    with pytest.raises(TypeError):
        get(heat=1)
    asked = spark.createDataFrame([(1, "ab"), (2, "b")], "query_id int, prompt string")
    bytes_ = Y.Bigrams.fit(spark.createDataFrame([([97, 98, 99, 97],)], "ids array<int>"), "ids", 256)
    got = {r["query_id"]: r["answer"] for r in Y.answered(asked, lambda x: list(x.encode()), lambda x: bytes(x).decode(), bytes_, max_new=3, temperature=0).collect()}
    assert got == {1: "cab", 2: "cab"}


def test_sampling_rules_agree(spark):
    """The rules for a row of logits in Spark and in a generation batch are the same."""
    import numpy as np

    x = [0.1, 5.0, 2.0, 4.9, -1.0]
    row = spark.createDataFrame([(x, [1, 4])], "x array<double>, seen array<int>")
    for how in ({}, {"temperature": 0.7}, {"top_k": 2}, {"top_p": 0.6}, {"temperature": 0}, {"penalty": 1.5}, {"penalty": 1.5, "top_k": 2, "top_p": 0.1}):
        spark_ = row.select(E.sampler(F.col("x"), seen=F.col("seen"), **how).alias("y")).first()["y"]
        assert np.allclose(spark_, Y.distribution(np.array(x), [1, 4], **how))


def test_speculative_decoding(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    target, draft = Y.Bigrams(rng.integers(0, 9, (4, 4))), Y.Bigrams(rng.integers(0, 9, (4, 4)))
    prompts = spark.range(6000).select("id", F.array(F.lit(2)).alias("ids"))
    rows = Y.speculated(prompts, "id", "ids", target, draft, gamma=3, max_new=5).collect()
    assert all(len(r["ids"]) == 5 and r["accepted"] <= 3 * r["rounds"] for r in rows)
    for at in range(4):  # each token as the target alone would draw it after the one before
        for before in range(4):
            after = [r["ids"][at] for r in rows if (r["ids"][at - 1] if at else 2) == before]
            if len(after) > 800:
                assert np.abs(np.bincount(after, minlength=4) / len(after) - Y.distribution(target.logits[before], [])).max() < 0.06
    same = Y.speculated(prompts.limit(20), "id", "ids", target, target, gamma=3, max_new=8, temperature=0).collect()
    assert all(r["rounds"] == 2 and r["accepted"] == 6 for r in same)
    greedy = Y.generated(prompts.limit(1), "id", "ids", target, max_new=8, temperature=0).first()["ids"]
    assert all(r["ids"] == greedy for r in Y.speculated(prompts.limit(20), "id", "ids", target, draft, gamma=3, max_new=8, temperature=0).collect())


def test_request_bounds(spark):
    rows = [("x", 50, 1.0, None, None, 1.0), ("", 0, 2.5, 0, 0.0, 0.5), (None, 4097, -0.1, 1001, 1.5, 6.0), ("y" * 32769, None, None, 1, 1.0, 5.0)]
    t = spark.createDataFrame(rows, "prompt string, max_new_tokens int, temperature double, top_k int, top_p double, repetition_penalty double")
    every = ["prompt", "max_new_tokens", "temperature", "top_k", "top_p", "repetition_penalty"]
    assert [r["p"] for r in t.select(Y.request_problems(t).alias("p")).collect()] == [[], every, every, ["prompt"]]


def test_training(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    centre = rng.normal(size=(3, 6)) * 2
    y = rng.integers(0, 3, 600)
    x = centre[y] + rng.normal(size=(600, 6))
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(600)] + [(600, [0.0] * 6, -100), (601, None, 1), (602, [0.0] * 6, None)], "id long, x array<double>, y long")
    params = {"w": rng.normal(size=(3, 6)), "b": rng.normal(size=3)}
    grads, loss, n = N.gradients(rows, "x", "y", params)
    z = x @ params["w"].T + params["b"]
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    hot = np.eye(3)[y]
    assert n == 600 and math.isclose(loss, -np.log(p[np.arange(600), y]).mean()) and np.allclose(grads["w"], (p - hot).T @ x / 600) and np.allclose(grads["b"], (p - hot).mean(0))
    model = N.Training(N.linear_model(6, 3), N.Schedule(0.1, 2, 12), accumulate=2)
    records = N.train(rows.filter("id < 500"), "id", "x", "y", model, 64, save=(str(tmp_path), 6))
    assert sum(r["step_performed"] for r in records) == 12 == model.schedule.current and len(records) == 24 and model.best_loss < 0.8
    held = N.predicted(rows.filter("id between 500 and 599"), "x", model.params)
    assert E.top_k_accuracy(held, "logits", "y", 1).first()[0] > 0.85
    again = N.load_checkpoint(spark, f"{tmp_path}/step_12")
    assert again.schedule == model.schedule and again.optimiser.count == 12 and again.best_loss == model.best_loss and all(np.array_equal(again.params[k], model.params[k]) for k in model.params)
    assert all(np.array_equal(again.optimiser.first[k], model.optimiser.first[k]) for k in model.params)
    again.step(rows, "x", "y"), model.step(rows, "x", "y")
    a, b = again.step(rows, "x", "y"), model.step(rows, "x", "y")
    assert a == b and np.array_equal(again.params["w"], model.params["w"])
    with pytest.raises(FileNotFoundError):
        N.load_checkpoint(spark, f"{tmp_path}/step_7")
    with pytest.raises(Exception, match="out of range"):
        N.gradients(rows, "x", "id", params)
    assert not N.AdamW().step({"w": np.zeros(2)}, {"w": np.array([np.nan, 1.0])}, 0.1)
    plain = {"w": np.array([1.0, -2.0])}
    N.AdamW(decay=0.1, clip=0).step(plain, {"w": np.array([0.5, -0.25])}, 0.01)
    assert np.allclose(plain["w"], np.array([1.0, -2.0]) * (1 - 0.001) - 0.01 * np.sign([0.5, -0.25]), atol=1e-7)  # the first step is the sign
    lr = [r["lr"] for r in U.lr_schedule(spark, 0.1, 5, 50).orderBy("step").collect()]
    assert np.allclose([N.Schedule(0.1, 5, 50, i).lr() for i in range(51)], lr) and N.Schedule.of(N.Schedule(0.1, 5, 50, 7).state()).current == 7
    clock = iter(range(100))
    row = N.timed(lambda: E.perplexity(held, "logits", "y"), clock=lambda: float(next(clock)))
    assert row["eval_time_seconds"] == 1 and row["tokens_per_second"] == 100 and row["n_tokens"] == 100
    grid = N.throughput_grid(spark, [8, 16], [2], lambda s, b: None, clock=lambda: float(next(clock))).collect()
    assert [(r["seq"], r["batch"], r["tokens_per_second"]) for r in grid] == [(8, 2, 16.0), (16, 2, 32.0)]


def plain_block(x, m):
    import numpy as np

    norm = lambda a: a / np.sqrt((a * a).mean(1, keepdims=True) + 1e-6)

    def rope(a):
        angle = np.arange(len(a))[:, None] * 10_000.0 ** -(np.arange(2) / 2)
        left, right = a[:, :2], a[:, 2:]
        return np.concatenate([left * np.cos(angle) - right * np.sin(angle), right * np.cos(angle) + left * np.sin(angle)], axis=1)

    n = norm(x)
    s = rope(n @ m["q"].T) @ rope(n @ m["k"].T).T / 2
    s[np.triu_indices(len(x), 1)] = -np.inf
    p = np.exp(s - s.max(1, keepdims=True))
    h = x + (p / p.sum(1, keepdims=True)) @ (n @ m["v"].T) @ m["o"].T
    g = norm(h) @ m["gate"].T
    return h + (g / (1 + np.exp(-g)) * (norm(h) @ m["value"].T)) @ m["out"].T, norm


def test_block_and_model(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    shape = {"q": (4, 4), "k": (4, 4), "v": (4, 4), "o": (4, 4), "gate": (6, 4), "value": (6, 4), "out": (4, 6)}
    layers = [{k: rng.normal(size=s) for k, s in shape.items()} for _ in range(2)]
    plain = lambda m: {k: v.tolist() for k, v in m.items()}
    x = rng.normal(size=(5, 4))
    rows = spark.createDataFrame([(7, i, [float(v) for v in x[i]]) for i in range(5)], "g int, pos int, x array<double>")
    got = {r["pos"]: r["out"] for r in E.block_forward(rows, "g", "pos", "x", plain(layers[0])).collect()}
    assert np.allclose([got[i] for i in range(5)], plain_block(x, layers[0])[0])
    with pytest.raises(ValueError, match="missing"):
        E.block_forward(rows, "g", "pos", "x", {"q": [[1.0]]})
    table = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(5)], "id int, v array<double>")
    seqs = spark.createDataFrame([("a", [3, 1, 1]), ("b", [0])], "k string, ids array<int>")
    head = rng.normal(size=(5, 4))
    found = {(r["k"], r["pos"]): r["logits"] for r in E.model_forward(seqs, "k", "ids", table, "id", "v", [plain(m) for m in layers], head.tolist()).collect()}
    assert len(found) == 4
    for k, ids in (("a", [3, 1, 1]), ("b", [0])):
        h, norm = plain_block(x[ids], layers[0])
        h, norm = plain_block(h, layers[1])
        assert np.allclose([found[k, i] for i in range(len(ids))], norm(h) @ head.T)


def test_quantised_layers(spark):
    w = spark.createDataFrame([("a", 0, [1.0, -2.0]), ("a", 1, [0.5, 4.0]), ("b", 0, [0.0, 0.0])], "layer string, row int, w array<double>")
    get = lambda **how: {(r["layer"], r["row"]): (r["scale"], r["zero"], r["q"]) for r in E.quantised_layers(w, "layer", "row", "w", **how).collect()}
    assert get()["a", 0] == (2.0 / 127, 0, [64, -127]) and get()["b", 0] == (1.0 / 127, 0, [0, 0])
    assert get(per_channel=False)["a", 0] == (4.0 / 127, 0, [32, -64])
    scale, zero, q = get(per_channel=False, symmetric=False)["a", 1]
    assert math.isclose(scale, 6 / 255) and all(abs((v - zero) * scale - x) <= scale for v, x in zip(q, [0.5, 4.0], strict=True))
    assert get(bits=4, group=2)["a", 1][0] == 4.0 / 7
    with pytest.raises(ValueError):
        get(bits=3)


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text('{"model": {"d": 8, "deep": {"x": null}}, "name": "n"}')
    c = config.Settings(str(path))
    assert (c.get("model.d"), c.get("model.deep.x", 1), c.get("model.y", 3), c.get("name.x", 4), c.get("none")) == (8, None, 3, 4, None)
    path.write_text("")
    for wrong in (str(path), str(tmp_path / "gone")):
        with pytest.raises((ValueError, FileNotFoundError)):
            config.Settings(wrong)
    assert config.commit(str(tmp_path)) == "unknown" and config.commit(str(tmp_path / "gone")) == "unknown"
