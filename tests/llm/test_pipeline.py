import re
from collections import Counter

import pytest
import regex

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_ops import classes_of, distance, plain_alike, plain_mix, plain_packing, plain_shingles  # noqa: E402

from corpusloom.llm import quality  # noqa: E402


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "mix_sources", "pack"]
    now, ids = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, sf)
        rows = now.collect()
        ids.append({r["doc_id"] for r in rows})
        if i < 4:
            assert now.columns == docs.columns
            now = spark.createDataFrame(rows, docs.schema)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if i == 1:
            lines = [" ".join(x.split()) for r in rows for x in r["text"].split("\n") if x.split()]
            assert len(lines) == len(set(lines))
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    assert sorted(map(repr, corpus_pipeline.run(spark, sf).collect())) == sorted(map(repr, rows))


def java(pattern):
    """The same pattern for Python's regex module."""
    return regex.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: regex.escape(chr(int(m[1], 16))), pattern))


def plain_quality(text):
    """The text without what the line rules take, or None."""
    gaps = " \t\n\x0b\x0c\r"
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(three)
    if len(words) < 50 or 100 * len({i + k for i, x in enumerate(three) if count[x] > 1 for k in range(3)}) > 50 * len(words):
        return None
    out, chars, lost = [], 0, 0
    for raw in text.split("\n"):
        line = raw.strip(gaps)
        if not line:
            out.append(raw)
            continue
        open_, head = not java(quality.ENDS).search(line), java(quality.HEAD).match(line)
        upper, lower = len(regex.findall(r"\p{Lu}", line)), len(regex.findall(r"\p{Ll}", line))
        bad = open_ and not head or len(java(quality.SOME_MARK).findall(line)) > 0.25 * len(line.split()) or (upper >= 12 and upper > lower) or java(quality.NAV).search(line) or java(quality.BOILERPLATE).search(line)
        chars += len(line)
        lost += len(line) if bad else len(line) - len(head[1]) if open_ else 0
        if not bad:
            out.append(head[1] if open_ else raw)
    return "\n".join(out) if lost <= chars * 0.3 else None


def plain_line_dedup(docs):
    """From {doc_id: text}: the first line of each class stays."""
    lines = [(d, k, " ".join(x.split())) for d in sorted(docs) for k, x in enumerate(docs[d].split("\n")) if x.split()]
    texts = sorted(({x: x.split() for *_, x in lines}).values(), key=len)
    bags, up = [Counter(x) for x in texts], list(range(len(texts)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            if len(texts[j]) - len(a) > 2:
                break
            allowed = min(2, len(a) // 10)
            if allowed and sum(((bags[i] - bags[j]) + (bags[j] - bags[i])).values()) <= 2 * allowed and distance(a, texts[j]) <= allowed:
                up[root(i)] = root(j)
    texts = [" ".join(x) for x in texts]
    at, first, gone = {x: root(i) for i, x in enumerate(texts)}, {}, set()
    for d, k, x in lines:
        if first.setdefault(at[x], (d, k)) != (d, k):
            gone.add((d, k))
    out = {}
    for d, text in docs.items():
        kept = "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in gone)
        if kept.split() or not text.split():
            out[d] = kept
    return out


def plain_targets(sizes):
    """5, 2, 1 of 1.5 times all words, no more than twice a source's own, by sharing again what is over."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in sizes if x not in full) for s in sizes if s not in full}
        over = {s for s in share if share[s] > 2 * sizes[s]}
        if not over:
            return {s: round(share.get(s, 2.0 * sizes[s]), 6) for s in sizes}
        full |= over


def test_pipeline_brute_force(spark):
    """All stages in plain Python, over the whole smallest table."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    source = {r["doc_id"]: r["source"] for r in rows}
    docs = {r["doc_id"]: t for r in rows if (t := plain_quality(r["text"])) is not None}
    assert 50 < len(docs) < len(rows)
    deduped = plain_line_dedup(docs)
    sets = {d: plain_shingles(t) for d, t in deduped.items()}
    of, least = classes_of(sorted(set(sets.values()), key=sorted), plain_alike), {}
    for d in sorted(sets):
        least.setdefault(of[sets[d]], d)
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", deduped[d])) for d in least.values()}
    sizes = Counter()
    for d, n in words.items():
        sizes[source[d]] += n
    copies, _ = plain_mix([(d, n, source[d]) for d, n in words.items()], plain_targets(sizes))
    mix = [(d, n) for d, n in words.items() for _ in range(copies[d])]
    least_padding, order = plain_packing(mix)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted(mix)
    assert sum(r["padding"] for r in got) == least_padding
    bounds = sorted({r["bucket_len"] for r in got})
    want, seen = [], Counter()
    for d, n in order:
        width = next(b for b in bounds if n <= b)
        fit = 32_768 // width
        want.append((d, n, width, seen[width] // fit, seen[width] % fit))
        seen[width] += 1
    assert sorted((r["doc_id"], r["n_tokens"], r["bucket_len"], r["batch"], r["slot"]) for r in got) == sorted(want)


PROSE = [" ".join(f"word{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) + "." for k in range(6)]


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, extra columns with the names of inner ones; then the same table without rows."""
    rows = [(1, PROSE[0], "en", "a", 1), (1, PROSE[0], "en", "a", 1), (None, PROSE[1], None, None, None), (None, PROSE[0], "en", "a", 2), (3, None, None, "b", None), (4, "", "en", "b", 0), (4, PROSE[2], "en", None, 5),
            (5, PROSE[3] + "\n" + PROSE[4], "de", "b", 6), (6, " \n ", "de", "b", 7), (7, "short.", "de", "a", 8), (None, None, None, None, None), (8, (PROSE[5] + " ") * 400, "en", "c", 9)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, names)
    clash = ["q_text", "q_all", "line_row", "line_drop", "sim_id", "sim_keep", "mix_row", "mix_copies", "__row", "__text"]
    for k, table in enumerate((docs, docs.select("*", *[docs["lang"].alias(c) for c in clash]), docs.limit(0))):
        folder = f"{tmp_path}/t{k}"
        table.write.parquet(f"{folder}/documents.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.columns == table.columns, name
            now = spark.createDataFrame(now.collect(), table.schema)
        out = corpus_pipeline.run(spark, folder).collect()
        if k == 2:
            assert not out
            continue
        texts = Counter(r["text"] for r in now.collect())
        assert set(texts) == {PROSE[0], PROSE[1], PROSE[2], PROSE[3] + "\n" + PROSE[4]} and max(texts.values()) <= 2
        assert sorted(r["n_tokens"] for r in out) == sorted(n for t, n_ in texts.items() for n in [len(t.split())] * n_)
