"""Decontamination, main text, archives, toxicity."""

import hashlib
import random
import re

import pytest

from topicwise.llm import decontaminate, maintext, toxicity, warc

from .helpers import frame, rows_of, texts, words


def brute(docs, items, size=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc, text in docs:
        have, hit, found = cut(text), set(), set()
        for item, phrase in items:
            w = cut(phrase)
            n = min(size, len(w))
            for s in range(len(w) - n + 1 if n else 0):
                for p in range(len(have) - n + 1):
                    if have[p : p + n] == w[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(item)
        out.append((doc, len(have), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=repr)


def test_decontamination(spark):
    rng = random.Random(7)
    item = words(rng, 40).split()
    items = [(1, " ".join(item)), (2, "Short one, HERE"), (3, None), (4, " .,; "), (5, " ".join(item[5:25])), (10, "short one here"), (None, "without an id")]
    items += [items[0], (6, "the the the the the the the the the the the the the the")]
    docs = [*texts(), (20, f"{words(rng, 9)} {' '.join(item[3:30])} {words(rng, 5)}"), (21, " ".join(item[:12])), (22, "x short ONE... here short one here y")]
    docs += [(23, "the " * 40), (24, " ".join(item).upper() + " " + " ".join(item[7:21])), (25, "a text without an id"), (26, "Été-short one here")]
    docs = [d for d in docs if d[0] != 10]
    out = decontaminate.decontaminate(frame(spark, docs), frame(spark, items, "item_id bigint, text string"))
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out.collect()], key=repr) == brute(docs, items)


def test_decontamination_with_nothing(spark):
    docs, items = frame(spark, texts()), frame(spark, [], "item_id bigint, text string")
    assert {r["n_hit"] for r in decontaminate.decontaminate(docs, items).collect()} == {0}
    assert decontaminate.decontaminate(frame(spark, []), frame(spark, [(1, "a b c")], "item_id bigint, text string")).count() == 0


def test_blocks_of_terms_and_proximity(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 4)
    docs, items = [(1, "one two three four five six seven"), (2, "seven six")], [(1, "two three four"), (2, "six seven"), (3, "seven six five")]
    out = decontaminate.decontaminate(frame(spark, docs), frame(spark, items, "item_id bigint, text string"))
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out.collect()], key=repr) == brute(docs, items)
    terms = spark.createDataFrame([("four", 0)], "term string, block int")
    postings = decontaminate.index(spark.createDataFrame(docs, "doc_id bigint, text string"), terms, 4)
    queries = spark.createDataFrame([(7, "four", ["two", "six"]), (8, "four", ["one"])], "query int, term string, others array<string>")
    near = decontaminate.proximity_matches(postings, queries, 2)
    assert [(r["query"], r["doc"], r["pos"]) for r in near.collect()] == [(7, 1, 3)]


def test_main_text(spark):
    shell = "<html><head><title>T</title><script>var a='<p>';</script></head><body><nav><a href='/'>Home</a></nav>{}<footer>&copy; x</footer></body></html>"
    article = "<article><header><h1>Head &amp; tail</h1></header><p>One <b>bold</b>\n  line<p>Two<br>lines &#8364;<aside>ad</aside><div class='comments'><p>no</p></div></article>"
    menu, legal = "<div>news sport weather travel money shop more today now</div>", "<div>all rights of this text stay with the owner of it</div>"
    rows = [(1, "http://a.com/1", shell.format(article)), (2, "http://a.com/2", None), (3, None, ""), (4, "http://c.com", "plain <i>text</i> &lt;b&gt;")]
    rows += [(10 + i, f"https://www.b.com/{i}", shell.format(f"{menu}<div><p>story {i} told in words of its own {i}</p></div>{legal}")) for i in range(4)]
    rows += [(None, "http://d.com", "<form><p>x</p></form><div class='cookie-notice'>we use</div><p hidden>y</p><p>kept</p>"), (1, "http://a.com/1", shell.format(article))]
    out = maintext.main_text(frame(spark, rows, "page_id bigint, url string, html string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    expected = {1: "Head & tail\nOne bold line\nTwo lines €", 2: "", 3: "", 4: "plain text <b>", None: "kept"}
    expected |= {10 + i: f"story {i} told in words of its own {i}" for i in range(4)}
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["text"], r["n_chars"]) == (expected[r["page_id"]], len(expected[r["page_id"]]))
    assert maintext.main_text(frame(spark, [], "page_id bigint, url string, html string")).count() == 0


def test_attributes_are_read_as_pairs():
    text = lambda page: [t for _, t in maintext.blocks(page)]
    for attributes in ("title='hidden gems'", 'data-id="comments"', "data-role='search'", "alt=\"it's id=nav\"", "data-hidden", "my-style='display:none'"):
        assert text(f"<article><p {attributes}>told</p></article>") == ["told"]
    assert text('<p>see <a href="/x?id=nav">the page</a></p>') == ["see the page"]
    for attributes in ("hidden", "HIDDEN=''", "class = comments", "data-x='1' id=\"comments\"", "title='a'style='display:none'"):
        assert text(f"<article><p {attributes}>gone</p><p>told</p></article>") == ["told"]


def test_dropped_inline_elements_do_not_end_a_block():
    text = lambda page: [t for _, t in maintext.blocks(page)]
    assert text("<p>One <svg>x</svg> two <button>b</button> three</p>") == ["One two three"]
    assert text("<p>One <button><div>b</div></button> two <span class='ad'><b>c</b></span>three</p>") == ["One two three"]
    assert text("<p>One</p><div class='share'>s<article><p>two</p></article>s</div><p>three</p>") == ["One", "two", "three"]
    assert text("<p>One<aside><p>a</p></aside>two") == ["One", "two"]
    assert text("<p>One<div>x</div>two</p>three") == ["One", "x", "two", "three"]
    assert text("<article>" + "<p>long one</p>" * 20_000 + "</article>") == ["long one"] * 20_000


def test_wrappers_named_after_parts():
    text = lambda page: [t for _, t in maintext.blocks(page)]
    for name in ("layout with-sidebar", "post comments-open share", "content has-ads", "noSidebar", "menu-open", "ad-free", "sidebar-layout"):
        assert text(f"<div class='{name}'><p>told</p></div>") == ["told"]
    assert text("<div id='content-no-sidebar'><article><p>told</p></article></div>") == ["told"]
    for name in ("share", "site-header", "search-wrapper", "notice"):  # the wrapper goes, the article in it stays
        assert maintext.blocks(f"<div class='{name}'><p>no</p><article><p>told</p></article><p>no</p></div>") == [(False, "told")]
    assert text("<form><p>no</p><main>told<aside>no</aside></main></form>") == ["told"]
    for name in ("comments", "comment-list", "left-sidebar", "widget-area", "relatedPosts", "share comments", "post sidebar", "ad"):
        assert text(f"<div class='{name}'><article><p>no</p></article></div>") == []
    for name in ("nav-primary", "main-menu", "cookie-notice", "mainNav", "pagination", "share"):
        assert text(f"<div class='{name}'><p>no</p></div>") == []
    assert text("<aside><article>no</article></aside><div hidden><main>no</main></div><nav><article>no</article></nav>") == []
    assert text("<div class='share'><div class='comments'><article class='comment'>no</article></div></div>") == []


def test_main_text_of_copies(spark):
    rng = random.Random(12)
    menu, legal = words(rng, 15), words(rng, 12)
    story = [words(rng, 80) for _ in range(5)]
    page = "<body><div>{}</div><div><p>{}</p><p>{}</p></div><div>{}</div></body>"
    whole = lambda s, n="": page.format(menu, s, f"seen {n}", legal)
    rows = [(1, "http://a.com/1", whole(story[0])), (2, "http://m.a.com/1", whole(story[0])), (3, "http://www.a.com/1?from=x", whole(story[0]) + " ")]
    rows += [(4, "http://a.com/2?n=4", whole(story[1], "once")), (5, "http://a.com/2?n=5", whole(story[1], "twice")), (6, "http://a.com/3", whole(story[2]))]
    rows += [(7, "http://b.com/1", whole(story[3])), (8, "http://b.com/1?y", whole(story[3]))]  # nothing but copies
    rows += [(20 + i, f"http://a.com/copy{i}", whole(story[4], i)) for i in range(30)]
    got = {r["page_id"]: r["text"].split("\n") for r in maintext.main_text(frame(spark, rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows)
    of = {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2} | {20 + i: 4 for i in range(30)}
    for i, s in of.items():
        assert story[s] in got[i] and menu not in got[i] and legal not in got[i]
    assert got[7] == got[8] == [menu, story[3], "seen", legal]


def test_articles_take_part_in_the_array(spark):
    rng = random.Random(31)
    menu, legal, note = words(rng, 12), words(rng, 9), words(rng, 20)
    story = [words(rng, 60) for _ in range(6)]
    shell = lambda inside: f"<body><div>{menu}</div>{inside}<div>{legal}</div></body>"
    rows = [(i, f"http://a.com/{i}", shell(f"<article><p>{story[i]}</p><p>{note}</p></article>")) for i in range(2)]
    # Without an article, the only such page of its host: those of the others show its menu.
    rows.append((2, "http://a.com/2", shell(f"<p>{story[2]}</p>")))
    # What no other page has is content outside an article too; what an article has elsewhere is not.
    rows.append((3, "http://a.com/3", shell(f"<p>{story[3]}</p><article>{story[4]}</article><div>{note}</div>")))
    rows += [(4 + i, f"http://b.com/{i}", shell(f"<article>{story[5]}</article>")) for i in range(2)]  # alone but for a copy
    rows += [(6, "http://c.com/", None), (7, "http://c.com/1", shell(f"<p>{story[0]}</p>"))]
    got = {r["page_id"]: r["text"] for r in maintext.main_text(frame(spark, rows, "page_id bigint, url string, html string")).collect()}
    expected = {0: f"{story[0]}\n{note}", 1: f"{story[1]}\n{note}", 2: story[2], 3: f"{story[3]}\n{story[4]}", 4: story[5], 5: story[5], 6: ""}
    assert got == expected | {7: f"{menu}\n{story[0]}\n{legal}"}


def test_main_text_against_all_pairs(spark):
    """Blocks inside and outside articles, compared place by place with all other pages of the host."""
    rng = random.Random(17)
    common = [words(rng, rng.randrange(1, 14)).split() for _ in range(15)]
    pages, rows = [], []
    for i in range(60):
        inside, found = rng.choice([(), (0,), (1, 2), (3,)]), []
        for b in range(4):
            found.append((b not in inside, sum([rng.choice([*common, words(rng, rng.randrange(1, 14)).split()]) for _ in range(rng.randrange(1, 4))], [])))
        pages.append((i, "abcd"[i % 4], found))
    for i, h, found in pages:
        markup = "".join(f"<{(tag := 'div' if is_open else 'article')}>{' '.join(w)}</{tag}>" for is_open, w in found)
        rows.append((i, f"http://{h}.com/{i}", markup))

    def runs(w):
        return [(at, tuple(w[at : at + 8])) for at in range(len(w) - 7)] or [(0, (*w, None))]

    expected = {}
    for i, h, found in pages:
        others = {x for j, g, bs in pages if g == h and j != i for _, w in bs for _, x in runs(w)}
        kept = []
        for is_open, w in found:
            cover = {at + k for at, x in runs(w) if x in others for k in range(min(8, len(w)))}
            if not is_open or len(cover) < 0.5 * len(w):
                kept.append(" ".join(w))
        expected[i] = "\n".join(kept)
    df = frame(spark, rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in maintext.main_text(df.repartition(3)).collect()}
    assert got == expected and any(t.count("\n") < 3 for t in got.values())


@pytest.mark.parametrize("partitions", [1, 5])
def test_suffix_array(spark, partitions):
    """Longest prefixes shared with another page of the host; what they cover is what a comparison of all places covers."""
    rng = random.Random(3)
    rows = [(i, i % 7, "ab"[i % 2], [[rng.randrange(1, 3) for _ in range(rng.randrange(1, 30))] for _ in range(3)]) for i in range(24)]
    rows.append((30, 30, "c", [[1] * 20]))  # alone on its host
    pages = spark.createDataFrame(rows, "row bigint, page bigint, host string, codes array<array<bigint>>")
    array = maintext.suffixes(pages.repartition(partitions), run=4, depth=9)
    found = {(r["row"], r["block"], r["at"]): r["n"] for r in maintext.repeated_prefixes(array, 4).collect()}
    every = [(r, p, h, b, at, tuple((c if len(c) >= 4 else [*c, 0])[at:][:9])) for r, p, h, cs in rows for b, c in enumerate(cs) for at in range(max(len(c) - 3, 1))]
    assert sorted(every) == sorted((r["row"], r["page"], r["host"], r["block"], r["at"], tuple(r["suffix"])) for r in array.collect())
    cover, expected = {(r, b, at + k) for (r, b, at), n in found.items() for k in range(n)}, set()
    for r, p, h, b, at, x in every:
        longest = 0
        for _, q, g, _, _, y in every:
            if g == h and q != p:
                longest = max(longest, next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))))
        longest = longest if longest >= min(len(x), 4) else 0
        n = max(longest - (x[-1] == 0), 0)
        assert n >= found.get((r, b, at), 0) >= min(n, 4)  # ranges end between neighbours
        if partitions == 1 and n:
            assert found[r, b, at] >= 1
        expected |= {(r, b, at + k) for k in range(n)}
    assert cover == expected and any(n > 4 for n in found.values())


def test_common_prefixes():
    rows = [("a", [1, 2, 3], 1), ("a", [1, 2, 3, 4], 1), ("a", [1, 2, 3, 4, 5], 2), ("a", [1, 3], 2), ("b", [1, 3], 3), ("b", [1, 3, 7], 4)]
    batch = maintext.pa.RecordBatch.from_pylist([{"host": h, "suffix": x, "page": p} for h, x, p in rows])
    assert maintext.common_prefixes(batch).tolist() == [3, 4, 4, 1, 2, 2]


@pytest.mark.parametrize("split", ["128m", "1k"])
def test_archive(spark, tmp_path, split):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"
    long = "é" * 600
    rows = [(1, "http://a/\r\nx", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", inner + long), (7, "u", "x" + inner * 3)]
    rows += [(None, "u", long), (9, "u", long), (9, "u", long), (10, "u", "WARC/1.1"), (11, "u", "")] + [(20 + i, "u", f"{i} page {'y' * 700}") for i in range(30)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        path = warc.write_archive(frame(spark, rows, "page_id bigint, url string, html string").repartition(2).cache(), str(tmp_path / "w"))
        out = warc.read_archive(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = []
    for i, _, payload in rows:
        data = (payload or "").encode()
        revisit = payload == long and i != 9
        expected.append((None if i is None else str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", "9" if revisit else None))
    assert sorted(map(repr, expected)) == sorted(repr((r["id"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"])) for r in out)


def test_archive_joined_by_salt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "small", lambda df: False)
    rows = [(i, "u", "z" * 1200) for i in range(20)] + [(50, "u", "q" * 1100)]
    out = warc.read_archive(spark, warc.write_archive(frame(spark, rows, "page_id bigint, url string, html string"), str(tmp_path / "w")))
    assert out.filter("type = 'response'").count() == 2
    assert out.filter("type = 'revisit' AND refers_to = '19'").count() == 19


def test_toxicity(spark):
    rng = random.Random(8)
    clean = [" ".join(f"wo{rng.choice('abcdefgh')}{rng.choice('klmnop')}" for _ in range(60)) for _ in range(240)]
    bad = [" ".join([*t.split()[:30], f"grumble{rng.choice('xyz')}{rng.choice('uvw')}", *t.split()[30:]]) for t in clean[:60]]
    model = toxicity.fit(clean[60:] + bad, [0] * 180 + [1] * 60)
    assert sum(p >= 0.5 for p in model.scores(clean[:60])) <= 3
    unseen = [t.replace("grumble", "grumbles-grumbl").replace("x", "q") for t in bad]  # misspelt in a way not trained on
    assert sum(p >= 0.5 for p in model.scores(unseen)) >= 50
    out = toxicity.score(frame(spark, texts()), model).collect()
    assert len(out) == len(texts()) and all(0 <= r["score"] <= 1 for r in out)
    empty = {r["score"] for r in out if not (r["text"] or "").strip()}
    assert len(empty) == 1


def test_toxicity_without_labels(spark):
    docs = frame(spark, texts())
    model = toxicity.train(docs, spark.createDataFrame([(1, None), (99, 1), (None, 1)], "doc_id bigint, toxic int"))
    assert {round(r["score"]) for r in toxicity.score(docs, model).collect()} == {0}
    assert rows_of(toxicity.score(frame(spark, []), model)) == []


def test_toxicity_sample_is_balanced_and_bounded(spark):
    docs = frame(spark, [(i, f"text {i}") for i in range(40)] + [(None, "unnamed"), (3, None), (4, "x" * 50)])
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(40)] + [(1, 0), (8, 0), (None, 1)], "doc_id bigint, toxic int")
    for rows, ones in ((6, 3), (20, 5), (1000, 5)):
        found, marks = toxicity.sample(docs, labels, toxicity.Settings(sample_rows=rows, sample_chars=20), "doc_id", "text", "toxic")
        assert sum(marks) == ones and len(found) == len(marks) == min(rows, 40)
        assert {t for t, y in zip(found, marks) if y} <= {f"text {i}" for i in range(0, 40, 8)}
        assert (found, marks) == toxicity.sample(docs.repartition(3), labels, toxicity.Settings(sample_rows=rows, sample_chars=20), "doc_id", "text", "toxic")
