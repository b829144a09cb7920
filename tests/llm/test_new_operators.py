"""Vector codes, conversation tries and token files against plain versions, with every odd case."""

import hashlib
import io
import json
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ebbtide.llm import conversation_trie as trie
from ebbtide.llm import token_files as tokens
from ebbtide.llm import vector_codes as codes

# -- vector codes


def plain_codes(rows, entries, rounds, parts=4):
    kept = [(i, [math.floor(1024.0 * float(x)) for x in v], l) for i, v, l in rows if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = 8 // parts
    pieces = [[tuple(v[p * cut:(p + 1) * cut]) for _, v, _ in kept] for p in range(parts)]
    books = [list(x[:entries]) for x in pieces]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for x in pieces[p]:
                mine[nearest(x, books[p])].append(x)
            for e, xs in mine.items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out = []
    for k, (i, _, label) in enumerate(kept):
        found = [nearest(pieces[p][k], books[p]) for p in range(parts)]
        out.append((i, tuple(found), sum(far(pieces[p][k], books[p][e]) for p, e in enumerate(found)), label))
    return sorted(out, key=repr), books


def test_vector_codes(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3 if i % 5 else None) for i in range(400)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(120)] + [rows[9], rows[9], (None, [0.5] * 8, 2), (3000, [90000.0] * 8, 1)]
    rows += [(-5, None, 1), (-4, [], 1), (-3, [1.0] * 3, 1), (-2, [math.nan] * 8, 1), (2000, [None] + [1.0] * 7, 1), (2001, [math.inf] * 8, 1), (2002, [1.0] * 4, 1)]
    frame = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], "vec_id bigint, embedding array<float>, label int, codes int, error string").repartition(3)
    exact = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    for entries in (16, 256):
        got, books = codes.vector_codes(frame, entries=entries, rounds=3)
        want, want_books = plain_codes(exact, entries, 3)
        assert sorted(((r.vec_id, tuple(r["codes"]), r.error, r.label) for r in got.collect()), key=repr) == want
        assert [[tuple(e) for e in b.tolist()] for b in books] == want_books
    got, books = codes.vector_codes(frame.limit(0))
    assert got.count() == 0 and books == []


def test_trees_hold_every_point_once_and_prune_exactly():
    rng = np.random.default_rng(2)
    points = np.floor(np.concatenate((rng.normal(0, 50, (700, 4)), rng.normal(900, 5, (300, 4)), np.full((200, 4), 7.0))))
    tree = codes.build(points)
    assert sorted(tree.order.tolist()) == list(range(len(points))) and tree.n[0] == len(points) and (tree.sums[0] == points.sum(axis=0)).all()
    entries = np.concatenate((points[:40], points[:3], points[-2:])).astype(np.int64)
    book = codes.Codebook(entries)
    sums, counts, found = codes.assign(tree, points.astype(np.int32), book, True)
    want = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (found == want).all() and (counts == np.bincount(want, minlength=len(entries))).all()
    assert (sums == np.array([points[want == e].sum(axis=0) for e in range(len(entries))])).all()
    assert len(codes.anchors(np.ones((50, 4)), np.arange(50), 7)) == 1


# -- conversation tries


def plain_trie(rows, family=5, most=9):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}|{role}|{text}".encode()).hexdigest()[:32]
            conv[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in conv.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = tuple(own.get(c - int(math.fmod(c, family)), [])[:h] + turns[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids[k])
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), leaves[k], saved[k],
                    hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(k)).encode()).hexdigest()) for k, m in members.items()), key=repr)


def test_conversation_trie(spark):
    rng = random.Random(8)
    say = lambda n: [(rng.choice(["user", "assistant", None]), rng.choice(["yes", "no", "é" * 3, "", None])) for _ in range(n)]
    stem, rows = say(40), []
    for c in [*range(-6, 60), 10**12]:
        turns = stem[:rng.choice([0, 3, 8, 16, 24, 40])] + say(rng.choice([1, 2, 9]))
        rows += [(c, t if t else None, *x) for t, x in enumerate(turns)]
    rows += [(100 + c, t, *x) for c in range(30) for t, x in enumerate(stem[:17])] + [(7, 3, "user", "tie"), (7, 3, "user", "tie"), (None, 1, "user", "lost")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, digest string, depth int").repartition(5)
    for block in (2, 8):
        turns, convs = trie.spliced(trie.ordered_turns(frame), 5, 9)
        got = trie.prefix_trie(turns, convs, block)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(rows)
    turns, convs = trie.spliced(trie.ordered_turns(frame.limit(0)), 5, 9)
    assert trie.prefix_trie(turns, convs).count() == 0


# -- token files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_are_encoded_as_whole_texts():
    from tokenizers import Tokenizer

    own, encode, rng = Tokenizer.from_file(PATH), tokens.encoder(open(PATH, encoding="utf-8").read(), 0), random.Random(1)
    marks = [*"abz AZ  \n\t\r.,;:'!-–éüßñ    \x1c\x0b\x0c\x85 　漢字123ª٣€😀", "'s", "'re", "<|endoftext|>", " <|endoftext|>", "\r\n", "3.14", "it's."]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(3000)] + [None, "", "x" * 5000]
    want = [np.asarray([*own.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes() for t in texts]
    assert encode(texts) == want
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["normalizer"] = {"type": "Lowercase"}  # such a tokenizer gets whole texts
    lower = tokens.encoder(json.dumps(spec), 0)
    assert lower(["AB cd"]) == encode(["ab cd"])


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip_and_random_access(kind):
    rng = np.random.default_rng(6)
    for n in (1, 7, 8, 9, 300):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert (tokens.ids_from(tokens.planes_of(ids, kind), n, kind) == ids).all()

    class Kept(io.BytesIO):
        def close(self):
            pass

        def size(self):
            return len(self.getvalue())
    stream = Kept()
    writer = tokens.PlaneWriter(stream, block_ids=10, kind=kind)
    docs = [(None, 1), (3, 25), (3, 1), (9, 40), (12, 3)]
    data = [rng.integers(0, 50_000, n).astype("<u4") for _, n in docs]
    for (doc, _), ids in zip(docs, data):
        writer.add(doc, ids.tobytes())
    assert writer.close() == (70, 5)
    reader, whole = tokens.PlaneReader(stream), np.concatenate(data)
    assert len(reader.chunks) == 7 and all((reader.ids(a, n) == whole[a:a + n]).all() for a in (0, 9, 33) for n in (0, 1, 12, 37))
    assert list(reader.documents()) == [(doc, sum(k for _, k in docs[:i]), n, zlib.crc32(ids.tobytes())) for i, ((doc, n), ids) in enumerate(zip(docs, data))]
    with pytest.raises(ValueError):
        tokens.PlaneReader(Kept(stream.getvalue()[:-1] + b"x"))


def test_token_files(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 50, f"Text number {i}, and so on. " * (i % 9)) for i in range(50)] + [(None, "lost"), (3, "twice"), (3, "twice"), (60, None), (61, ""), (62, "long " * 30_000)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, file string, part int").repartition(4)
    for size in (1 << 30, 5000):
        manifest = tokens.write_token_files(frame, PATH, block_ids=64, file_text_bytes=size, kind="bit" if size == 5000 else "byte")
        got = sorted((tuple(r) for r in tokens.read_token_files(manifest).collect()), key=lambda r: r[1])
        ids = {t: np.asarray([*own.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for _, t in rows}
        key = lambda d: (d is not None, d or 0)
        assert [key(r[0]) for r in got] == sorted(key(d) for d, _ in rows) and [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
        assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == sorted(((d, len(ids[t]), zlib.crc32(ids[t].tobytes())) for d, t in rows), key=repr)
        assert manifest.count() == 1 or size == 5000
    assert tokens.read_token_files(tokens.write_token_files(frame.limit(0), PATH)).count() == 0


def test_new_pieces_share_calls_of_the_tokenizer(monkeypatch):
    import tokenizers

    own, strings = tokenizers.Tokenizer.from_file(PATH), []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        @staticmethod
        def from_str(text):
            return Counted(real.from_str(text))

        def encode_batch_fast(self, texts, **options):
            strings.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

    real = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    mark = "\U000F8FF0"
    texts = [" ".join(f"word{i}x{j}" for j in range(100)) for i in range(50)] + [None, "", f"a{mark} {mark}b <|endoftext|>{mark}", mark, "a× b÷. é. 中. ...", "", "word1x1"]
    want = [np.asarray([*own.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes() for t in texts]
    encode = tokens.encoder(open(PATH, encoding="utf-8").read(), 0)
    assert encode(texts) == want
    assert len(strings) < 100  # 5,000 distinct words and more; each was a string of its own
    strings.clear()
    assert encode(pa.array(["lost", *texts, "lost"])[1:-1]) == want and encode([]) == [] and encode([None]) == want[50:51]
    assert all(mark in s for s in strings)  # pieces with the mark may be long; others are known by now


def test_pieces_start_where_the_plain_pattern_parts():
    import re

    plain = re.compile("(?=[ \t\r\n.,:;])(?:(?<=[!-~À-ÖØ-öø-ÿ])(?=[ \t\r\n])|(?<=[A-Za-z0-9À-ÖØ-öø-ÿ])(?=[.,:;]))")
    rng, marks = random.Random(2), [*"abzAZ09  \t\r\n.,:;'!-~×÷éÿÀ¿ª–中\U0001f600\x00\x7f\x85"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 30))) for _ in range(2000)]
    pieces, bounds = tokens.pieces_of(pa.array(["cut", *texts])[1:])
    got = [[p.decode() for p in pieces[int(lo):int(hi)].to_pylist()] for lo, hi in zip(bounds, bounds[1:])]
    assert got == [plain.split(t) if t else [] for t in texts]
