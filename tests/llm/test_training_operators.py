"""Operators of the training-data package against plain versions, and on odd input."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.llm import decontamination, html_extract, licenses, near_dup, packing, pii, quality_classifier, quality_rules, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, source string, lang string, score string, kept string, n_words string, doc string, list string, size string, key string, bucket string"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))


def odd(spark):
    """NULLs, empty, blank and very long texts, ties, repeated rows, and extra columns under names that operators use."""
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, LONG), (6, LONG), (6, LONG), (None, "no id here at all"), (None, None), (7, "a b c d e f g h i j")]
    return spark.createDataFrame([(i, t, None if i == 4 else "s", None, "x", "y", "z", "q", None, "1", "2", "3") for i, t in texts], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


# toxicity ---------------------------------------------------------------------------------------------------------------

def plain_segments(x):
    """By definition: repeatedly take the best segment (shortest, first) of what is left on both sides."""
    best = None
    for a in range(len(x)):
        for b in range(a + 1, len(x) + 1):
            s = sum(x[a:b])
            if s > 0 and (best is None or s > best[2] or (s == best[2] and b - a < best[1] - best[0])):
                best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    return plain_segments(x[:a]) + [best] + [(p + b, q + b, t) for p, q, t in plain_segments(x[b:])]


def test_segments_match_definition():
    rnd = random.Random(3)
    for _ in range(200):
        x = [rnd.choice([-3, -2, -1, 1, 2, 5]) + rnd.random() / 10 for _ in range(rnd.randrange(0, 14))]
        got = toxicity.maximal_segments(np.array(x))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain_segments(x)]


def test_segments_of_long_clean_text_in_linear_time():
    before = time.process_time()
    got = toxicity.maximal_segments(np.tile([1.0, -2.0], 60_000))
    assert len(got) == 60_000 and time.process_time() - before < 10


def test_toxicity_learns_and_finds_the_passage(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(600):
        text = [rnd.choice(words) for _ in range(60)]
        if i % 5 == 0:
            text[30:30] = rnd.sample(["idiot", "moron", "scum", "trash"], 3)
        rows.append((i, " ".join(text)))
        marks.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, labels(spark, marks, "toxic"), F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert all((got[i].predicted == 1) == (i % 5 == 0) for i in got)
    found = toxicity.passages(docs.filter("doc_id = 10"), model).collect()
    assert any(re.search("idiot|moron|scum|trash", rows[10][1][p.start:p.end]) for p in found)


def test_toxicity_odd_input(spark):
    docs = odd(spark)
    model = toxicity.fit(docs, labels(spark, [(4, 1), (4, 0), (7, 0), (None, 1), (5, None)], "toxic"))
    got = toxicity.score_documents(docs, model).select("doc_id", "score", "predicted").collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    empty = toxicity.fit(none(spark), labels(spark, [], "toxic"))
    assert toxicity.score_documents(none(spark), empty).count() == 0
    assert {r.score for r in toxicity.score_documents(docs, empty).collect()} == {0.5}


def test_word_count_of_an_extreme_value_model():
    s = np.array([2.0, -0.25])
    rate = toxicity.solve_rate(np.array([0.05, 0.95]), s)
    assert math.isclose(0.05 * math.exp(2 * rate) + 0.95 * math.exp(-0.25 * rate), 1, rel_tol=1e-6)


# licences ---------------------------------------------------------------------------------------------------------------

def plain_licence(text, files, threshold=licenses.THRESHOLD):
    vocabulary = {t for s in licenses.TEMPLATES.values() for x in s for t in licenses.terms(x)}
    df = Counter(t for f in files for t in set(licenses.terms(f or "")) & vocabulary)
    n = len(files)
    idf = {t: math.log((n + 1) / (df[t] + 1)) + 1 for t in vocabulary}
    best = []
    for s in re.split(licenses.STATEMENT, (text or "").lower()):
        v = {t: c * idf.get(t, math.log(n + 1) + 1) for t, c in Counter(licenses.terms(s)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        for name, _, w in licenses.template_vectors(idf):
            score = round(sum(v.get(t, 0) * x for t, x in w.items()) / norm, 9) if norm else 0
            if score >= threshold:
                best.append((-score, name))
    return min(best)[1] if best else None


def test_licences_match_plain_scan_and_inherit(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "plain words of a file"), ("a/b/c/y.txt", "more of the plain words"), ("d/z.txt", "nothing here"),
             ("d/q.txt", "long text of a file " * 20 + "\nLicensed under the Apache License, Version 2.0."), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
             ("top.txt", "the license of the world"), (None, "Released under the MIT License."), ("e/n.txt", None), ("e/m.txt", "")]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect() if r.path}
    for p, t in files:
        if p:
            assert got[p].own_licence == plain_licence(t, [f[1] for f in files]), p
    assert (got["a/b/x.txt"].licence, got["a/b/x.txt"].inherited_from) == ("GPL-3.0", "a/b")
    assert got["a/b/c/y.txt"].licence == "GPL-3.0" and got["d/z.txt"].licence is None and got["e/n.txt"].licence is None
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


# decontamination --------------------------------------------------------------------------------------------------------

def plain_distance(item, words):
    row = [0] * (len(words) + 1)
    for x in item:
        new = [row[0] + 1]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_against_edit_distance(spark):
    rnd = random.Random(8)
    vocabulary = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(15, 45)))) for i in range(20)]
    rows, missed, near = [], 0, 0
    for d in range(120):
        w = items[d % 20][1].split()
        for _ in range(rnd.randrange(0, len(w) // 3)):
            p = rnd.randrange(len(w))
            w[p:p + rnd.randrange(0, 2)] = [rnd.choice(vocabulary)] * rnd.randrange(0, 2)
        rows.append((d, " ".join([rnd.choice(vocabulary) for _ in range(40)] + w + [rnd.choice(vocabulary) for _ in range(40)])))
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, t in rows:
        for i, x in items:
            k = plain_distance(x.split(), t.split())
            if k <= int(0.2 * len(x.split())):
                near += 1
                missed += (d, i) not in got
            else:
                assert (d, i) not in got
    assert near > 60 and missed <= 0.02 * near
    assert decontamination.tables_for(0.998, 0.5) <= decontamination.WALKS * decontamination.SAMPLES


@pytest.mark.parametrize("size", [15, 60, 120, 250, 500])
def test_long_items_are_found_at_the_bound(size):
    rnd = random.Random(size)
    word = lambda: f"v{rnd.randrange(20_000)}"
    items = [(i, " ".join(word() for _ in range(size))) for i in range(20)]
    index, lost = decontamination.Index(items), 0
    for i, text in items:
        for insert in (True, False):
            w = text.split()
            for p in sorted(rnd.sample(range(size), size // 5), reverse=True):
                w[p:p + (not insert)] = [word()] * insert
            got = index.match(decontamination.hashed(" ".join([word() for _ in range(30)] + w + [word() for _ in range(30)]), {}))
            lost += (i, plain_distance(text.split(), w)) not in [(m[0], m[1]) for m in got] if size < 250 else i not in [m[0] for m in got]
    assert lost <= 1


def test_short_items_and_scripts_without_blanks(spark):
    thai, chinese = "\u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22\u0e40\u0e1b\u0e47\u0e19\u0e20\u0e32\u0e29\u0e32", "\u4e2d\u534e\u4eba\u6c11\u5171\u548c\u56fd\u7684\u9996\u90fd\u662f\u5317\u4eac"
    items = spark.createDataFrame([(1, "Why not?"), (2, "who goes there"), (3, chinese), (4, thai), (5, "what is it now"), (6, "\u6771\u4eac")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "he said: why NOT go, why not"), (2, "who really goes there"), (3, "\u524d" * 40 + chinese.replace("\u662f", "\u5728") + "\u5f8c" * 40),
                                  (4, f"x {thai} y"), (5, "so what is it now"), (6, "\u6771\u5317\u4eac"), (7, "\u5728\u6771\u4eac")], "doc_id long, text string")
    got = sorted(tuple(r) for r in decontamination.matches(docs, items).collect())
    assert [r[:3] for r in got] == [(1, 1, 0), (3, 3, 1), (4, 4, 0), (5, 5, 0), (7, 6, 0)]
    assert got[0][3:] == (2, 2, 4)
    assert sorted(r.doc_id for r in decontamination.keep(docs, items).collect()) == [2, 6]


def test_decontamination_odd_input(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, ""), (4, "one"), (5, "a b c d e f g h")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontamination.matches(odd(spark), items).collect())
    assert got == [(7, 1), (7, 5)]
    kept = decontamination.keep(odd(spark), items)
    assert kept.columns == odd(spark).columns and kept.count() == 9
    assert decontamination.keep(none(spark), items).count() == 0
    assert decontamination.matches(odd(spark), items.limit(0)).count() == 0


# quality rules ----------------------------------------------------------------------------------------------------------

def test_text_stats_by_definition():
    rnd = random.Random(2)
    for _ in range(100):
        text = "".join(rnd.choice("aab  \n\t#$é ") for _ in range(rnd.randrange(0, 120)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        twice = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) for k in range(3) if twice[g] > 1}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality_rules.text_stats(text) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_hosts_are_judged_with_a_prior(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, "fine") for i in range(200)] + [(200 + i, "bad", "worst") for i in range(100)] + [(300, good, "worst"), (301, "bad", "small"), (302, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.report(docs).collect()}
    assert got[0].kept and not got[300].kept and not got[300].base_failed and got[302].kept
    assert quality_rules.keep(docs).count() == 201


def test_quality_rules_odd_input(spark):
    got = quality_rules.report(odd(spark)).collect()
    assert len(got) == 10 and {r.n_words for r in got if r.doc_id in (1, 2, 3)} == {0}
    kept = quality_rules.keep(odd(spark))
    assert kept.columns == odd(spark).columns
    assert quality_rules.report(none(spark)).count() == 0 and quality_rules.keep(none(spark)).count() == 0


# near-duplicates --------------------------------------------------------------------------------------------------------

def plain_groups(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"t{rnd.randrange(500)}" for _ in range(rnd.randrange(5, 160))]
        for _ in range(rnd.randrange(1, 14)):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 12)):
                w[rnd.randrange(len(w))] = f"t{rnd.randrange(500)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "One Two"), (len(rows) + 3, "one two"), (len(rows) + 4, "one")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == plain_groups(rows, 3, 85)


def pairs_at(similarities, words=200, width=5):
    """Rows (2i, 2i + 1) whose sets of ``words`` shingles are as similar as asked, by a new end of the second text."""
    rows = []
    for i, s in enumerate(similarities):
        other = round(words * (1 - s) / (1 + s))
        a = [f"p{i}w{k}" for k in range(words + width - 1)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(a[:len(a) - other] + [f"q{i}w{k}" for k in range(other)]))]
    return rows


def test_threshold_of_80_percent(spark):
    rows = pairs_at([0.78 + k / 400 for k in range(40)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(rows, 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, 5, 80).collect()} == want
    assert want != plain_groups(rows, 5, 85)
    assert {r.doc_id for r in near_dup.keep(docs, 5, 80).collect()} == {i for i, (_, c) in want.items() if i == c}
    for percent in (50, 80, 85, 95, 100):
        bands, width = near_dup.layout(percent)
        assert bands * width <= near_dup.PLACES and (1 - (percent / 100) ** width) ** bands <= near_dup.MISS
    assert near_dup.layout(85) == (84, 12)


def test_blocks_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    test_near_duplicates_against_all_pairs(spark)


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(6)
    a = rnd.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rnd.integers(0, 2**63, 100).astype(np.uint64)])
    x, y = near_dup.signatures([np.unique(a), np.unique(b)])
    assert abs((x == y).mean() - 0.6) < 0.06
    assert (near_dup.signatures([a[:1]]) < near_dup.EMPTY).all() and near_dup.signatures([a[:0]]).min() == near_dup.EMPTY


def test_near_duplicates_odd_input(spark):
    got = near_dup.near_duplicates(odd(spark), 3, 85).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[6].component_id == 5 and not by[6].kept and by[1].kept and by[1].n_shingles == 0
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    kept = near_dup.keep(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 8
    assert near_dup.near_duplicates(none(spark)).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 103), (103, 100)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.comp for r in near_dup.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 103: 100}


# personal data ----------------------------------------------------------------------------------------------------------

def plain_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_against_patterns():
    rnd = random.Random(7)
    for _ in range(3000):
        t = "".join(rnd.choice(["a", "@", "b.", ".", "1", "25", "256", " ", "-", "+", "4111 1111 1111 1111", "+1 (555) 123-4567", "é", "1.2.3.4", "x@y.z"]) for _ in range(rnd.randrange(0, 14)))
        assert pii.base_spans(t) == plain_base(t), t


def test_field_labels_repeated_entities(spark):
    texts = [f"call +1 555 123 {k:04d} or write to user{k}@site.org today" for k in range(200)] + ["phone +49 151 23456789 office, again 151 23456789 there", "order 12345678901 only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field = pii.fit(docs)
    got = {r.doc_id: r for r in pii.report(docs, field).collect()}
    assert got[200].n_phone == 1 and got[200].n_added == 1 and got[200].spans.count("phone") == 2
    assert got[201].spans == "" and got[201].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "[phone]" in {r.doc_id: r.text for r in pii.mask(docs, field).collect()}[3]


def test_belief_propagation_is_exact_on_a_chain():
    rnd = np.random.default_rng(3)
    field = pii.Field(rnd.normal(size=(4 * pii.CELLS, 5)), np.zeros(5), rnd.normal(size=(5, 5)), 1.0)
    cells = np.array([[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12]])
    node = field.nodes[cells].sum(axis=1)
    node[:, pii.NONE] += pii.RULE_FAILED
    joint = np.exp(node[0][:, None, None] + node[1][None, :, None] + node[2][None, None, :] + field.chain[:, :, None] + field.chain[None])
    want = joint.sum(axis=(0, 2)) / joint.sum()
    assert np.allclose(pii.infer(field, cells, [-1, -1, -1], [])[1], want, atol=1e-3)


def test_personal_data_odd_input(spark):
    field = pii.fit(odd(spark))
    assert pii.report(odd(spark), field).count() == 10
    masked = pii.mask(odd(spark), field)
    assert masked.columns == odd(spark).columns and masked.filter("doc_id = 1").first().text is None
    assert pii.report(none(spark), pii.fit(none(spark))).count() == 0
    many = "1" * 200_000 + "@" * 1000 + "+" * 1000 + "a" * 200_000
    assert pii.base_spans(many) == []


# pages ------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">x</a></li></ul></nav>
<div class="cookie-notice">We use</div><article><h1>Head &amp; more</h1><p><b>One.<br><p>Two  three&nbsp;four</p><form>f<input></form><div class="ad">buy</div><section class="comments"><p>c</p></section></article>
<aside>s</aside><footer>&copy; z</footer></body></html>"""


def test_main_text_of_a_page(spark):
    pages = spark.createDataFrame([(1, "http://h.org/a", PAGE), (2, "http://h.org/b", None), (3, None, ""), (4, "x", "<p>a<p>b &lt;c"), (5, "http://h.org/c", "x < y <a title='>'>z</a> <im"), (5, "http://h.org/c", "x < y <a title='>'>z</a> <im")],
                                  "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("n_chars", F.lit("old"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert got == {1: ("Head & more One. Two three four", 31), 2: ("", 0), 3: ("", 0), 4: ("a b <c", 6), 5: ("x < y z", 7)}
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_style_tree_removes_what_repeats_on_a_host(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><div class='main'><p>text {i} of page {i * 7}</p></div><div class='box'><p>the same on all pages</p></div></body>") for i in range(60)]
    rows += [(100 + i, f"http://other{i}.org/", f"<body><div class='main'><p>other {i}</p></div></body>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert all(got[i] == f"text {i} of page {i * 7}" for i in range(60)) and got[103] == "other 3"
    split = {r.page_id: r.text for r in html_extract.extract(pages, most=1).collect()}
    assert split == got


def test_copies_of_a_page_stay_whole(spark):
    bodies = {"wrapped": ("<article><div class='content'><p>one two</p><ul><li>three</li></ul><table><tr><td>four</td></tr></table><dl><dt>five</dt><dd>six</dd></dl></div></article>", "one two three four five six"),
              "main": ("<main><div><p>seven eight</p><figure><figcaption>nine</figcaption></figure></div></main>", "seven eight nine"),
              "plain": ("<div><p>ten eleven</p></div>", "ten eleven")}
    rows = [(f"{name}{i}", f"http://{name}{h}.org/{i}", f"<body>{body}</body>") for name, (body, _) in bodies.items() for i in range(60) for h in (("",) if i < 30 else (i,))]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert len(got) == 180 and all(r.text == bodies[r.page_id.rstrip("0123456789")][1] for r in got)


# packing ----------------------------------------------------------------------------------------------------------------

def test_boundaries_are_optimal():
    from itertools import combinations
    rnd = random.Random(5)
    for _ in range(60):
        lengths = sorted(rnd.sample(range(1, 40), rnd.randrange(1, 9)))
        counts = [rnd.randrange(1, 9) for _ in lengths]
        for k in (1, 2, 3):
            def cost(bounds):
                return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))
            best = min(cost([*x, lengths[-1]]) for x in combinations(lengths[:-1], min(k, len(lengths)) - 1))
            assert cost(packing.boundaries(np.array(lengths), np.array(counts), k)) == best


def test_packing_keeps_every_token_and_fills_batches(spark):
    rnd = random.Random(9)
    docs = spark.createDataFrame([(i, "w " * rnd.randrange(0, 300)) for i in range(400)], "doc_id long, text string")
    rows = packing.pack(docs, max_length=100, buckets=4, budget=500).collect()
    want = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    have = Counter()
    for r in rows:
        have[r.doc_id] += r.n_tokens
        assert r.n_tokens <= 100 and (r.bucket >= 0) == (r.n_tokens > 0)
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in have.items() if v} and {r.doc_id for r in rows} == set(want)
    for b in {r.bucket for r in rows} - {-1}:
        own = [r for r in rows if r.bucket == b]
        fits = 500 // own[0].bound
        sizes = Counter(r.batch for r in own)
        assert sorted(sizes) == list(range(len(sizes))) and all(sizes[k] == fits for k in list(sizes)[:-1] if k != max(sizes)) and len({(r.batch, r.place) for r in own}) == len(own)
    assert packing.pack(odd(spark)).filter("n_tokens > 0").count() >= 6 and packing.pack(none(spark)).count() == 0


# quality classifier -----------------------------------------------------------------------------------------------------

def test_interactions_in_linear_time_equal_all_pairs():
    rnd = np.random.default_rng(2)
    model = quality_classifier.Model(0.3, rnd.normal(size=quality_classifier.WIDTH), rnd.normal(size=(quality_classifier.WIDTH, quality_classifier.FACTORS)))
    rows = [np.unique(rnd.integers(0, quality_classifier.WIDTH, 20)) for _ in range(4)]
    at, x, starts = quality_classifier._packed(rows)
    for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(at)])):
        want = 0.3 + sum(model.weights[at[i]] * x[i] for i in range(a, z))
        want += sum(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i in range(a, z) for j in range(a, i))
        assert math.isclose(model.margins(rows)[k], want, rel_tol=1e-9)


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = quality_classifier.fit(docs, marks, ~held)
    rows = quality_classifier.score_documents(docs, model).join(marks.filter(held), "doc_id").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_quality_classifier_odd_input(spark):
    model = quality_classifier.fit(odd(spark), labels(spark, [(4, 1), (7, 0), (7, 1), (None, 0)], "quality"))
    assert quality_classifier.score_documents(odd(spark), model).count() == 10
    empty = quality_classifier.fit(none(spark), labels(spark, [], "quality"))
    assert {r.score for r in quality_classifier.score_documents(odd(spark), empty).collect()} == {0.5}
    assert quality_classifier.score_documents(none(spark), empty).count() == 0


# repeated passages ------------------------------------------------------------------------------------------------------

def plain_removed(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - 99):
            if seen.setdefault(raw[s:s + 100], (i, s)) != (i, s):
                gone[s:s + 100] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    return out


def passage_rows(seed):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(60, 400))) for _ in range(6)] + ["x" * 250, "ab" * 130]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rnd.randrange(0, 4)):
            p = rnd.choice(pool)
            a = rnd.randrange(0, len(p))
            parts += [p[a:a + rnd.randrange(50, 400)], "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 60)))]
        rows.append((i, "".join(parts)))
    return rows + [(40, None), (41, rows[3][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_passages_against_all_windows(spark, seed):
    rows = passage_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_removed(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect()}
    assert got == want
    hot = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs, hot_runs=2, sample=1).collect()}
    assert hot == want


def test_suffix_order_and_collision_fallback():
    rnd = np.random.default_rng(4)
    text = rnd.integers(97, 99, (300, 40)).astype(np.uint8)
    size = rnd.integers(0, 41, 300)
    text[np.arange(40)[None] >= size[:, None]] = 0
    group = np.sort(rnd.integers(0, 5, 300))
    order, lcp = suffix_dedup.suffix_order(text, size, group)
    raw = [text[i, :size[i]].tobytes() for i in range(300)]
    assert [(group[i], raw[i]) for i in order] == sorted(zip(group, raw))
    plain = suffix_dedup.plain_order(text, size, group)
    assert [raw[i] for i in plain[0]] == [raw[i] for i in order] and (plain[1] == lcp).all()


def test_chunks_of_long_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 150)
    rows = passage_rows(3)
    data = [(i, (t or "").encode()) for i, t in rows]
    bounds = np.cumsum([0] + [len(x) for _, x in data])
    runs = suffix_dedup.runs_of(np.frombuffer(b"".join(x for _, x in data), dtype=np.uint8), bounds, np.array([i for i, _ in data]), np.zeros(0, dtype=np.int64))
    assert sum(int(r["size"]) - 99 for r in runs) == sum(max(0, len(x) - 99) for _, x in data)


def test_repeated_passages_odd_input(spark):
    got = {r.doc_id: r for r in suffix_dedup.dedup(odd(spark)).collect()}
    assert got[6].n_removed == got[6].n_bytes and got[1].n_bytes == 0 and got[4].n_removed == 0
    assert suffix_dedup.dedup(none(spark)).count() == 0


def test_near_duplicates_send_no_pairs_of_a_group(spark, monkeypatch):
    base = [f"w{i}" for i in range(400)]

    def changed(i: int) -> list[str]:
        places = random.Random(i).sample(range(399), 8)
        return [f"x{i}p{p}" if p in places else w for p, w in enumerate(base)]

    # copies that share buckets but stay below the threshold, and one beside copy 17 that reaches it
    rows = [(i, " ".join(changed(i))) for i in range(1, 41)] + [(50, " ".join([*changed(17)[:-1], "y"]))]
    seen, verified = [], near_dup.verified
    monkeypatch.setattr(near_dup, "verified", lambda pairs, *more: seen.append(pairs.count()) or verified(pairs, *more))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in plain_groups(rows, 3, 85).items()} == {i: 17 if i == 50 else i for i, _ in rows}
    assert sum(seen) < 10 * len(rows)


def test_words_of_ascii_texts_need_no_search(monkeypatch):
    texts = ["a_b C9\x1cd\tE", "x\x00y", "don't A-B.c_d", "", *[chr(c).join("ab") for c in range(128)]]
    want = [decontamination.WORD.findall(t.lower()) for t in texts]
    monkeypatch.setattr(decontamination, "WORD", None)
    for t, words in zip(texts, want):
        cache = {}
        assert len(decontamination.hashed(t, cache)) == len(words) and set(cache) == set(words)
