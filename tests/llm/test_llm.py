"""The training-data operators against plain versions, on small tables with every odd case."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from ebbtide.llm import contamination, exact_dedup, html_text, jaccard, licenses, line_chunks, mixing, personal_data, repeats, toxicity

SCHEMA = "doc_id bigint, text string, source string, row string, digest string, n bigint"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def texts():
    rng = random.Random(3)
    vocabulary = ["w" + "".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 8))) for _ in range(400)]

    def line(n):
        return " ".join(rng.choices(vocabulary, k=n))
    passage = "\n".join(line(12) for _ in range(9))
    base = ["\n".join(line(rng.randint(3, 14)) for _ in range(rng.randint(2, 14))) for _ in range(40)]
    near = [b.replace(b.split()[5], "other", 1) for b in base[:12]]
    return [None, "", "   ", "Éé ñ", "one two", "ONE TWO", *base, *base[:6], *near, base[1].upper(), *(b + "\n" + passage + "\n" + b[:40] for b in base[20:26]),
            "x" * 700, " ".join(base) * 3]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["a", "b", None, ""][i % 4], "r", "d", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "no id", "a", None, None, None), rows[8]], SCHEMA)


def content(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_contamination(spark, docs):
    source = texts()
    items = spark.createDataFrame([(1, " ".join(words(source[7])[3:20])), (10, "two"), (2, None), (3, ""), (None, "ñ"), (1, "two")], "item_id bigint, text string")
    want = defaultdict(Counter)
    windows = defaultdict(set)
    for item, text in [(r.item_id, r.text) for r in items.collect()]:
        w = words(text)
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k:k + m])].add(item)
    for doc, text in content(docs):
        w, hit, ids = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if (found := windows.get(tuple(w[k:k + m]))):
                    hit.update(range(k, k + m))
                    ids |= found - {None}
        want[doc, len(w), len(hit), tuple(sorted(ids))] = want[doc, len(w), len(hit), tuple(sorted(ids))]
        want[doc, len(w), len(hit), tuple(sorted(ids))] = 1
    for block in (1 << 20, 1):  # all items at once, and one by one
        got = contamination.contamination(docs, items, block_bytes=block).select("row.doc_id", "n_words", contamination.hit_words("spans").alias("n"), "items").collect()
        assert {(r.doc_id, r.n_words, r.n, tuple(r["items"])) for r in got} == set(want) and len(got) == docs.count()
    kept = contamination.without_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in got if r.n == 0)
    assert contamination.contamination(docs.limit(0), items).count() == 0 and contamination.without_contaminated(docs, items.limit(0)).count() == docs.count()


def test_personal_data(spark):
    seen = [f"mail: a{i}@b.example.org now" for i in range(8)] + ["mail: id77x now", "call +1 (171) 555-2028 or 4111 1111 1111 1111, 10.0.0.256 10.0.0.25", None, "", "a@b.c_d@e.f", "9" * 5000]
    rows = spark.createDataFrame(list(enumerate(seen)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in personal_data.personal_data(rows).collect()}
    assert [(s.start, s.end) for s in got[0].email] == [(6, 22)] and not got[10].email and not got[11].email
    assert [(s.start, s.end) for s in got[9].phone] == [(5, 22)] and [(s.start, s.end) for s in got[9].card] == [(26, 45)]
    assert [s.body for s in got[9].ip] == ["10.0.0.25"] and [s.body for s in got[12].email] == ["a@b.c", "_d@e.f"]
    assert [(s.start, s.end) for s in got[8].context] == [(6, 11)] and not got[9].context and not got[13].card
    assert personal_data.personal_data(rows.limit(0)).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[ -]?[0-9])+",
         "phone": r"\+[0-9][ ().0-9-]+[0-9]"}


def passes(kind, body):
    number = [int(x) for x in body if x.isascii() and x.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in body.split("."))
    if kind == "card":
        doubled = [x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(number))]
        return 16 <= len(number) <= 19 and sum(doubled) % 10 == 0
    return 8 <= len(number) <= 15 if kind == "phone" else True


def test_base_formats_on_random_text(spark):
    """The four formats equal their plain patterns, leftmost and non-overlapping."""
    rng = random.Random(11)
    pieces = ["a", "Z", "7", "0", "25", "255.", "1.", "@", ".", "-", " ", "+", "(", ")", "_", "%", "é", "😀", "\n", "x@y.z", "+1 (17", "4111 1111 1111 1111", "10.0.0.25", "4111-1111"]
    seen = ["".join(rng.choices(pieces, k=rng.randint(1, 60))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(seen)), "doc_id bigint, text string")
    count = Counter()
    for r in personal_data.personal_data(rows).collect():
        for kind, pattern in PLAIN.items():
            want = [m.span() for m in re.finditer(pattern, seen[r.doc_id]) if passes(kind, m[0])]
            assert [(s.start, s.end) for s in r[kind]] == want, (kind, seen[r.doc_id])
            count[kind] += len(want)
    assert min(count[k] for k in PLAIN) > 20


def test_bootstrapped_shapes(spark):
    """Seeds lead to keys by the words after both, keys to a pattern of their own, and that to a second shape; nothing else is added."""
    rng = random.Random(4)
    key = lambda n: "".join(rng.choices("0123456789abcdef", k=n - 1)) + "7"
    seen = [f"we wrote a{i}@b.example.org {w} it" for i in range(12) for w in ("soon", "twice")]
    seen += [f'the secret = "{key(40)}" {w} it' for _ in range(6) for w in ("soon", "twice")]
    seen += [f'old secret="{key(24)}" zzz{i} it' for i in range(6)]
    plain = [f"in version 4.0.12345678 zzz{i} and 20{i} too" for i in range(10)] + [f"code {key(30)} of {i}" for i in range(8)]
    odd = [None, "", "5" * 3000, "secret", 'secret = "', "w" * 300 + " x9@ " + "v" * 300]
    rows = [(i, t, "c", "s") for i, t in enumerate([*seen, *plain, *odd])] + [(None, seen[24], "c", "s")]
    docs = spark.createDataFrame([*rows, rows[25]], "doc_id bigint, text string, key string, shape string")
    got = personal_data.personal_data(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        text = seen[24] if r.doc_id is None else [*seen, *plain, *odd][r.doc_id]
        want = [m.span() for m in re.finditer("[0-9a-f]{24,40}", text)] if r.doc_id is None or 24 <= r.doc_id < len(seen) else []
        assert [(s.start, s.end) for s in r.context] == want, text
    again = personal_data.personal_data(docs, rounds=1).collect()
    assert not any(r.context for r in again if r.doc_id is not None and 36 <= r.doc_id < len(seen))


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_groups(spark, docs, tmp_path, bits):
    docs.repartition(3).write.parquet(str(tmp_path / "d"))
    groups = defaultdict(list)
    for doc, text in content(docs):
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), text or "")].append(doc)
    got = exact_dedup.exact_groups(spark, str(tmp_path / "d"), digest_bits=bits, files_per_batch=1).collect()
    assert len(got) == docs.count() and sum(r.kept for r in got) == len(groups)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(ids), max((x for x in ids if x is not None), default=None))


def test_line_chunks(spark, docs):
    seen = defaultdict(set)
    rows = {(d, t) for d, t in content(docs)}
    for doc, text in rows:
        for number, _, _, body in line_chunks.pieces((text or "").encode(), line_chunks.SPAN, line_chunks.DIVISOR, 2):
            seen[body].add((-1 if doc is None else doc, number))
    got = line_chunks.without_repeated_chunks(docs).select("row.*", "n_removed_chunks", "n_lines").collect()
    assert len(got) == docs.count() and sum(r.n_removed_chunks for r in got) > 5
    for r in {(r.doc_id, r.text, r.n_removed_chunks, r.row) for r in got}:
        original = next(t for d, t in rows if d == r[0])
        found = [(n, b) for n, _, _, b in line_chunks.pieces((original or "").encode(), line_chunks.SPAN, line_chunks.DIVISOR, 2)]
        gone = [b for n, b in found if min(seen[b]) != ((-1 if r[0] is None else r[0]), n)]
        assert r[2] == len(gone) and (r[1] is None) == (original is None)
    assert line_chunks.without_repeated_chunks(docs.limit(0)).count() == 0


def test_line_runs_go_to_their_ends(spark):
    rng = random.Random(8)

    def line(n=30):
        return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passages = [[line() for _ in range(k)] for k in (2, 2, 3, 4, 7)]
    source = []
    for i in range(60):
        lines = [line() for _ in range(rng.randint(2, 6))]
        if i % 3 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = passages[i // 3 % 5]
        source.append(lines)
    source += [source[4], source[9], ["same"] * 4, [line(), "alone", ""], ["alone", "", line()], [passages[0][0], "", passages[0][1]]]
    source[50][1:1] = source[20][-1:] + source[20][:1]  # neighbours in no other document
    gone = defaultdict(set)
    runs = 0
    for a, x in enumerate(source):  # all maximal common runs of two documents, line by line
        for b in range(a + 1, len(source)):
            y = source[b]
            for i in range(len(x)):
                for j in range(len(y)):
                    if x[i] and x[i] == y[j] and (i == 0 or j == 0 or x[i - 1] != y[j - 1]):
                        n = 0
                        while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                            n += 1
                        if n >= 2 and sum(map(bool, x[i:i + n])) >= 2:
                            gone[b].update(range(j, j + n))
                            runs += len(" ".join(x[i:i + n]).split()) > 50
    gone[62] = {2, 3}  # of a line four times the first two are the first place
    frame = spark.createDataFrame([(d, "\n".join(x)) for d, x in enumerate(source)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in line_chunks.without_repeated_chunks(frame).select("row.*", "n_removed_lines").collect()}
    assert runs > 30
    for d, lines in enumerate(source):
        assert got[d].text == "\n".join(x for i, x in enumerate(lines) if i not in gone[d]) and got[d].n_removed_lines == len(gone[d])
    left = {x for r in got.values() for x in r.text.split("\n")}
    assert all(x in left for lines in source for x in lines if x)


def test_repeats(spark, docs):
    data = [(d, (t or "").encode()) for d, t in content(docs)]
    counts = Counter(b[i:i + 200] for _, b in data for i in range(len(b) - 199))
    want = Counter()
    for doc, b in data:
        keep = bytearray(b"\1" * len(b))
        for i in range(len(b) - 199):
            if counts[b[i:i + 200]] > 1:
                keep[i:i + 200] = bytes(200)
        spans = sum(1 for i in range(len(b)) if not keep[i] and (i == 0 or keep[i - 1]))
        want[doc, len(b), keep.count(0), spans, bytes(x for x, k in zip(b, keep, strict=True) if k)] += 1
    got = repeats.without_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert repeats.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [1000, 2])
def test_near_duplicates(spark, docs, blocks):
    sets = {}
    for doc, text in set(content(docs)):
        w = words(text)
        m = min(5, len(w))
        sets[doc] = {tuple(w[i:i + m]) for i in range(len(w) - m + 1)} if m else set()
    near = {a: [b for b in sets if b != a and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] for a in sets}
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs, block_classes=blocks).collect()}
    for a, others in near.items():
        group, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in group:
                    group.add(b)
                    todo.append(b)
        assert (got[a].n_links, got[a].group_size, got[a].group_id) == (len(others), len(group), min(group, key=lambda x: -1 if x is None else x))
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0
    assert jaccard.one_of_each_group(docs).select("doc_id").distinct().count() == len({r.group_id for r in got.values()})


def test_main_texts(spark):
    def page(i, body):
        return (i, f"http://h{i % 2}.example.org/{i}", f"<html><body><nav><a href='/'>Home page</a></nav><div class='post-{i}'><p>{body} &amp; more<p>Second\n  part, {i}."
                "<div class='comments'><p>Great comment, thanks a lot for that</div></div><script>var a='<p>no</p>'</script><footer>All rights</footer></body></html>")
    pages = spark.createDataFrame([page(i, "Some long text of the page " * 5) for i in range(6)] + [(9, None, None), (10, "x", "")], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_texts(pages).select("row.page_id", "text").collect()}
    for i in range(6):
        assert got[i] == ("Some long text of the page " * 5).strip() + f" & more\n\nSecond part, {i}."
    assert got[9] == got[10] == "" and html_text.main_texts(pages.limit(0)).count() == 0


NESTED = [
    ("headline and lead", "<nav><a href='/'>Home</a></nav><article><h1>T</h1><p>lead</p><div class=body>" + "<p>Body text of it.</p>" * 40 + "</div></article>",
     ["T", "lead", *["Body text of it."] * 40]),
    ("plain containers", "<div class=page><div class=post><h1>T</h1><div class=wrap><div class=body>" + "<p>Body text of it.</p>" * 40 + "</div></div></div>"
     "<div class=more><a href=1>Other one</a> <a href=2>Other two</a></div></div>", ["T", *["Body text of it."] * 40]),
    ("sections", "<div class=content><section id=intro><p>Short intro.</p></section><section id=methods>" + "<p>Methods used.</p>" * 30 + "</section></div>",
     ["Short intro.", *["Methods used."] * 30]),
    ("sections of two classes", "<div class=content><div class=wrap><section class=a><p>Short intro.</p></section></div><div class=wrap><div class=in><section class=b>"
     + "<p>Methods used.</p>" * 30 + "</section></div></div><div class=wrap><section class=c>" + "<p>Results seen.</p>" * 9 + "</section></div></div>",
     ["Short intro.", *["Methods used."] * 30, *["Results seen."] * 9]),
    ("headline in body", "<h1>T</h1><p>lead</p><div class=body>" + "<div class=in><p>Body text of it.</p></div>" * 9 + "</div>", ["T", "lead", *["Body text of it."] * 9]),
    ("headline in a container", "<div class=head><h1>T</h1></div><div class=body><p>Body text of it.</p></div>", ["T", "Body text of it."]),
    ("headline in main", "<main><h1>T</h1><article><p>Body text of it.</p></article></main>", ["T", "Body text of it."]),
    ("no container", "<h1>T</h1><p>Body text of it.</p>", ["T", "Body text of it."])]


@pytest.mark.parametrize("name,body,want", NESTED, ids=[x[0] for x in NESTED])
def test_main_text_is_whole(name, body, want):
    page = f"<html><body>{body}</body></html>"
    alone, voted = html_text.main_text(page, []), html_text.main_text(page, list(html_text.votes(page)))
    assert alone.split("\n\n") == voted.split("\n\n") == want
    assert html_text.main_text(page.replace("Body text of it.", "Other words."), list(html_text.votes(page))).split("\n\n")[0] == want[0]


def test_main_text_takes_more_than_the_hosts_container():
    page = "<body><div class=post><div class=body>" + "<p>Body text.</p>" * 20 + "</div>{}</div><div class=rail><p>Rail.</p></div></body>"
    usual, long = page.format(""), page.format("<div class=appendix>" + "<p>Appendix text.</p>" * 20 + "</div>")
    paths = list(html_text.votes(usual))
    assert html_text.main_text(usual, paths).split("\n\n") == ["Body text."] * 20
    assert html_text.main_text(long, paths).split("\n\n") == ["Body text."] * 20 + ["Appendix text."] * 20


LONG = "Words that belong to the text of the article and to nothing else. " * 4
PARTS = [  # inside the article: kept?
    ("<h2 id='side-effects'>Side effects</h2>", True), ("<h2 id='search-methods'>Methods</h2>", True), ("<p class='notice-period'>Notice</p>", True),
    ("<h2 class='related'>Related</h2>", True), ("<h2 id='navier-stokes'>Flow</h2>", True), ("<div id='promotion-rules'>Rules</div>", True),
    (f"<section id='related-work'><p>{LONG}</p></section>", True), ("<section id='comments'><p>Few</p></section>", False), ("<p>so <math><mi>x</mi><mo>=</mo></math></p>", True),
    ("<object data=x><p>Fallback</p></object>", True), ("<canvas>Fallback</canvas>", True), (f"<aside><p>{LONG}</p></aside>", True), ("<aside>Read on</aside>", False),
    (f"<div class='notice'>{LONG}</div>", False), ("<div class='related'><a href=1>" + LONG + "</a></div>", False), ("<div class='share'>Share</div>", False),
    ("<div class='ad-12'>Buy</div>", False), ("<nav>Parts</nav>", False), *((part.format(LONG), False) for part in (
        "<div class='comments'>{}</div>", "<section id='comments'><p>{}</p></section>", "<ol class='comment-list'><li>{}</li></ol>", "<div class='newsletter'>{}</div>",
        "<aside class='sidebar'><p>{}</p></aside>", "<div class='advert'>{}</div>", "<footer>{}</footer>", "<div class='user-comments'><p>{}</p></div>", "<div id='sidebar'>{}</div>",
        "<aside><div class='reader-comments'>{}</div></aside>")), (f"<div class='with-comments'><p>{LONG}</p></div>", True),
    (f"<section id='search'><p>{LONG}</p></section>", True), ("<p>is <code><span class='comment'># note</span></code></p>", True)]


@pytest.mark.parametrize("part,kept", PARTS)
def test_parts_inside_the_article(part, kept):
    said = " ".join(re.sub("<[^>]*>", "", part).split())
    page = f"<html><body><div class='sidebar'><p>{LONG}</p></div><article><h1>T</h1><p>{'First one. ' * 30}</p>{part}</article></body></html>"
    assert html_text.main_text(page, list(html_text.votes(page))).split("\n\n") == ["T", ("First one. " * 30).strip(), *[said] * kept]


def test_names_around_the_article():
    for wrap in ("<div class='overlay'>{}</div>", "<div id='search-results'>{}</div>", "<div class='with-sidebar'>{}</div>"):
        page = "<body><p>Above.</p>" + wrap.format("<article><p>Article.</p><div class='share'>Share</div></article>") + "</body>"
        assert html_text.main_text(page, []) == "Above.\n\nArticle."


def test_mixing(spark, docs):
    many = spark.range(3000).selectExpr("id as doc_id", "case when id % 10 < 6 then 'a' when id % 10 < 9 then 'b' else 'c' end as source")
    weights = spark.createDataFrame([("a", 7), ("b", 2), ("c", 1)], "source string, parts bigint")
    for chunk in (100, 100_000):
        got = mixing.mixed_order(many, weights, block_rows=10, chunk_rows=chunk).collect()
        assert len(got) == 3000 and len({r.row.doc_id for r in got}) == 3000
        slots = sorted({(r.slot, r.source) for r in got})
        assert len({s for s, _ in slots}) == len(slots) and all(r.released <= r.slot < r.due for r in got)
        had = Counter()
        for t, (slot, source) in enumerate(slots[:250]):  # until a source runs out
            had[source] += 1
            assert slot == t and all(abs(had[s] - (t + 1) * w / 10) < 1 for s, w in (("a", 7), ("b", 2), ("c", 1)))
    assert mixing.mixed_order(docs).count() == docs.count() and mixing.mixed_order(docs, weights).count() == docs.count()
    assert mixing.mixed_order(docs.limit(0)).count() == 0 and mixing.mixed_order(docs, weights.limit(0)).count() == docs.count()


def test_licenses(spark):
    long = licenses.TEMPLATES["MIT"]
    rows = spark.createDataFrame([(1, "blah " * 40 + long.upper() + " blah" * 9), (2, "Released under the MIT License."), (3, "released under an MIT-like license"),
                                  (4, None), (5, ""), (6, "word " * 33 + "Licensed under the Apache License, Version 2.0.")], "doc_id bigint, text string")
    got = {r.doc_id: [m.template for m in r.matches] for r in licenses.license_matches(rows).collect()}
    assert got == {1: ["MIT"], 2: ["MIT-notice"], 3: [], 4: [], 5: [], 6: ["Apache-2.0-notice"]}
    assert licenses.license_matches(rows, {}).count() == 6 and licenses.license_matches(rows.limit(0)).count() == 0


def test_license_table(spark):
    filler = "word " * 50
    full = (licenses.license_table.FULL_TEXTS / "GPL-2.txt").read_text(encoding="utf-8")
    want = {"All rights reserved.": "All-rights-reserved", "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0-only-SPDX", "Licensed under the MIT License": "MIT-notice",
            "This is MIT licensed": "MIT-notice", "under the GNU Lesser General Public License, version 2.1": "LGPL-2.1-notice", "GPLv2": "GPL-2.0-notice",
            "Mozilla Public License, v. 2.0": "MPL-2.0-notice", "CC BY-SA 4.0": "CC-BY-SA-4.0-notice", "Creative Commons Attribution-NoDerivatives 4.0": "CC-BY-ND-4.0-notice",
            "This is free software under the Unlicense": "Unlicense-notice", filler + full + filler: "GPL-2-text", "the software license of nobody": None}
    want |= {text: name for name, text in licenses.license_table.TEXTS}
    texts = list(want)
    frame = spark.createDataFrame([(i, "" if len(t) > 9000 else "one two " + t + " three four", t) for i, t in enumerate(texts)], "doc_id bigint, a string, b string")
    got = {r.doc_id: [m.template for m in r.matches] for r in licenses.license_matches(frame.selectExpr("doc_id", "if(a = '', b, a) as text")).collect()}
    for i, t in enumerate(texts):
        assert want[t] in got[i] if want[t] else not got[i], (t[:60], got[i])
    templates = spark.createDataFrame([("x", "eggs and more ham"), ("x", "ham and eggs"), ("y", None)], "template string, text string")
    rows = spark.createDataFrame([(1, "Ham and eggs!"), (2, "eggs and more ham"), (3, "eggs")], "doc_id bigint, text string")
    assert {r.doc_id: [m.template for m in r.matches] for r in licenses.license_matches(rows, templates).collect()} == {1: ["x"], 2: ["x"], 3: []}


def test_toxicity(spark):
    rng = random.Random(1)
    bad = ["zonk", "grub", "plonker"]
    rows = [(i, " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=30) + (rng.sample(bad, 2) if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    docs = frame.select("doc_id", "text").union(spark.createDataFrame([(None, None), (9999, "")], "doc_id bigint, text string"))
    scores = toxicity.fit(docs, frame.select("doc_id", "toxic")).score(docs)
    held = {r.doc_id: r.score for r in scores.where(toxicity.held_out("row.doc_id")).select("row.doc_id", "score").collect()}
    assert sum((held[i] >= 0.3) == bool(y) for i, _, y in rows if i in held) >= 0.97 * len([1 for i, *_ in rows if i in held])
    assert all(0 <= r.score <= 1 for r in scores.collect()) and scores.count() == 602
    assert toxicity.fit(docs, frame.select("doc_id", "toxic").limit(0)).score(docs.limit(0)).count() == 0


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{folder}/documents.parquet")
    after = corpus_pipeline.run(spark, folder)
    ids = [r.doc_id for r in after.select("doc_id").collect()]
    assert after.columns == [*before.columns, "mix_slot", "mix_place"] and len(ids) == len(set(ids)) > 0.6 * before.count()
