"""Each stage of the pipeline against a plain version, on one small table with planted cases."""

import math
import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline as pipeline
from ebbtide.llm import toxicity

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, mix_slot string, n_removed_lines int, row string"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def stage():
    return dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    vocabulary = ["w" + "".join(rng.choices("abcdefghij", k=6)) for _ in range(600)]
    line = lambda n=12: " ".join(rng.choices(vocabulary, k=n))
    base = ["\n".join(line() for _ in range(6)) for _ in range(60)]
    passage = "\n".join(line() for _ in range(5))
    near = [b.replace(b.split()[9], "other", 1).replace("\n", " ") for b in base[:8]]
    item = line(25)
    texts = [*base, *base[:5], *near, *(f"{line()}\n{passage}\n{line()}" for _ in range(3)), f"{line()} {item} {line()}", None, "", "!!", *("zonk plonker " + line(30) for _ in range(8))]
    rows = [(i, t, ["a", "b", None][i % 3], len(t or ""), "s", 1, "r") for i, t in enumerate(texts)]
    place = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([*rows, rows[3]], SCHEMA).write.parquet(str(place / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(str(place / "benchmark.parquet"))
    labels = [(i, int("zonk" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(str(place / "labels.parquet"))
    return str(place)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lines(spark, stage, docs, folder):
    """Every run of two lines that an earlier place has goes; a document left without words goes with it."""
    source = sorted({tuple(r) for r in docs.collect()}, key=lambda r: r[0])
    pairs = defaultdict(list)
    for r in source:
        lines = (r[1] or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip()]
        for a, b in zip(full, full[1:]):
            pairs["\n".join(lines[a:b + 1])].append((r[0], a, b))
    want = []
    for r in docs.collect():
        lines, gone = (r.text or "").split("\n"), set()
        for places in pairs.values():
            for d, a, b in places[1:]:
                if d == r.doc_id:
                    gone.update(range(a, b + 1))
        text = r.text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or words(text):
            want.append((r.doc_id, text, r.source, len(text) if gone else r.n_chars, *tuple(r)[4:]))
    got = stage["line_dedup"](spark, docs, folder)
    assert got.columns == docs.columns and rows_of(got) == sorted(want, key=repr) and len(want) < docs.count()


def test_near_duplicates(spark, stage, docs, folder):
    """Of documents linked by a similarity of 0.8 the smallest id stays, once."""
    grams = {}
    for r in docs.collect():
        w = words(r.text)
        grams[r.doc_id] = frozenset(tuple(w[i:i + min(5, len(w))]) for i in range(max(1, len(w) - 4))) if w else None
    root = {d: d for d in grams}
    for _ in grams:
        for a in grams:
            for b in grams:
                if grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[d]] == root[d] for d in root):
            break
    want = sorted({tuple(r) for r in docs.collect() if root[r.doc_id] == r.doc_id}, key=repr)
    got = stage["near_duplicates"](spark, docs, folder)
    assert got.columns == docs.columns and rows_of(got) == want and len(want) < docs.count() - 10


def test_decontamination(spark, stage, docs, folder):
    item = words(spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text)
    windows = {tuple(item[i:i + 10]) for i in range(len(item) - 9)}
    hit = lambda t: any(tuple(w[i:i + 10]) in windows for w in [words(t)] for i in range(len(w) - 9))
    want = sorted((tuple(r) for r in docs.collect() if not hit(r.text)), key=repr)
    got = stage["decontamination"](spark, docs, folder)
    assert got.columns == docs.columns and rows_of(got) == want and len(want) == docs.count() - 1


def test_toxicity(spark, stage, docs, folder):
    """What is below the limit stays, whole."""
    scores = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")).score(docs)
    want = sorted((tuple(r.row) for r in scores.collect() if r.score < 0.3), key=repr)
    got = stage["toxicity"](spark, docs, folder)
    assert got.columns == docs.columns and rows_of(got) == want


def test_mixing(spark, stage, docs, folder):
    """Plain earliest deadline first over the sources' blocks of 16 rows."""
    got = stage["mixing"](spark, docs, folder)
    assert got.columns == [*docs.columns, "mix_slot_", "mix_place"]
    rows = got.collect()
    assert sorted((tuple(r)[:7] for r in rows), key=repr) == rows_of(docs)
    counts = defaultdict(int)
    for r in rows:
        counts[r.source or ""] += 1
    roots = {s: math.sqrt(n) for s, n in counts.items()}
    parts = {s: max(1, round(1000 * x / sum(roots.values()))) for s, x in roots.items()}
    total, had, slots = sum(parts.values()), dict.fromkeys(parts, 0), {}
    for t in range(total):
        ready = [(math.ceil((had[s] + 1) * total / parts[s]), s) for s in sorted(parts) if had[s] < parts[s] and had[s] * total // parts[s] <= t]
        if ready:
            s = min(ready)[1]
            slots[s, had[s]] = t
            had[s] += 1
    for s, n in counts.items():
        mine = [(r.mix_slot_, r.mix_place) for r in rows if (r.source or "") == s]
        assert sorted(mine) == [(slots[s, k // 16], k % 16) for k in range(n)]


def test_whole_run(spark, folder, docs):
    """Copies, near copies, the contaminated and the toxic are gone; clean documents stay."""
    left = {r.doc_id for r in pipeline.run(spark, folder).collect()}
    assert set(range(8, 60)) <= left and not left & {*range(60, 73), 76} and {77, 78, 79} <= left
    assert all(pipeline.STAGES[k][1](spark, docs.limit(0), folder).count() == 0 for k in range(1, 5))
