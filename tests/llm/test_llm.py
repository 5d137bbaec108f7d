"""The training-data operators against brute force, round trips, held-out accuracy
and edge cases (nulls, empty and long texts, ties, repeated rows, empty tables,
clashing extra columns)."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, SF01
from tokenforge.llm import (byte_bpe, decontam, html_extract, jaccard_join, kd_shards, language_id, pii, quality_model,
                            quality_rules, toxicity)
from tokenforge.llm.queries import ORACLES, QUERIES
from tokenforge.llm.tokenizers import BYTE_BPE, pretoken_pattern, read_ranks

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig long, n long, words string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, ties, repeated rows, names that operators use."""
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t", "en", "a", 3), (4, LONG, "en", "b", len(LONG)),
            (5, same, "en", "b", 70), (5, same, "en", "b", 70), (6, same, None, "c", 70), (None, same, "en", None, 70),
            (None, None, "en", None, None), (7, "word", "de", "c", 4), (8, "7 @ + 1.2.3.4 \U0001f600", "de", "c", 9)]
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_oracles_match(spark):
    from tools.oracle_check import compare, duck_views
    con = duck_views(SF001)
    for name, sql in ORACLES.items():
        assert compare(spark, con, QUERIES[name], sql, SF001) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_queries_cover_their_tables(spark, name):
    table, key = ("pages", "page_id") if name.startswith("op4_") else ("documents", "doc_id")
    want = {r[0] for r in spark.read.parquet(f"{SF001}/{table}.parquet").select(key).collect()}
    got = [r[0] for r in QUERIES[name](spark, SF001).select(key).collect()]
    assert len(got) == len(want) and set(got) == want


# ---- decontamination

def contaminated(text, items, window=13):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = pat.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for item, t in items:
        w = pat.findall((t or "").translate(LOW))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j:j + n] == w[i:i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(words), len(hit), sorted(map(str, found))


def test_decontamination_brute_force(spark, odd):
    rng = random.Random(4)
    vocab = "a b c d e".split()
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 4, 5, 7, 13, 16, 30])))) for i in range(12)]
    items += [(12, None), (13, "..."), (14, items[0][1])]
    rows = [(100 + i, " ".join(rng.choices(vocab, k=rng.randint(0, 40)))) for i in range(60)]
    rows += [(200, items[7][1].upper() + "!"), (201, None), (202, items[5][1] + " zz " + items[6][1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), b))
    for i, t in rows:
        n, hit, found = contaminated(t, items)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (n, hit, found)
    assert decontam.decontaminate(odd, b.limit(0)).count() == odd.count()
    assert decontam.decontaminate(odd.limit(0), b).count() == 0
    clean = decontam.keep_clean(odd, spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string"))
    assert clean.columns == odd.columns and clean.count() == odd.count() - 4


# ---- toxicity, quality model, language: held-out accuracy

def test_toxicity_held_out(spark, odd):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels, ["doc_id"]).join(labels, "doc_id").collect()
    test = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == r["toxic"] for r in test]) >= 0.9
    out = toxicity.toxicity(odd, labels.limit(0), ["doc_id"]).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)


def test_quality_model(spark, odd):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    ratings = labels.select("doc_id", quality_model.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    got = quality_model.quality_model(docs, ratings, ["doc_id"]).join(labels, "doc_id").collect()
    test = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, poor = ([r["expected_grade"] for r in test if r["quality"] == q] for q in (1, 0))
    assert min(good) > max(poor) or np.mean([g > p for g in good for p in poor]) > 0.95
    p = quality_model.fit(["a b", "c d", "e f"] * 5, np.array([0, 1, 2] * 5), 3).probabilities(pa.array(["a b", "e f", ""]))
    assert np.allclose(p.sum(1), 1) and p[0] @ [0, 1, 2] < p[1] @ [0, 1, 2]
    assert quality_model.quality_model(odd, ratings.limit(0), ["doc_id"]).count() == odd.count()


def test_language(spark, odd):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = language_id.language_id(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    out = language_id.language_id(odd).collect()
    assert len(out) == odd.count()
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(r["lang_pred"] == "und" for r in language_id.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_automaton_parses_like_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        base = [rng.randint(1, 3) for _ in range(rng.randint(1, 40))]
        a = language_id.Automaton(base, 5)
        seq = [rng.randint(0, 4) for _ in range(rng.randint(1, 30))]
        have = {tuple(base[i:j]) for i in range(len(base)) for j in range(i + 1, len(base) + 1)}
        n, i = 0, 0
        while i < len(seq):
            k = 1
            while i + k < len(seq) and tuple(seq[i:i + k + 1]) in have and tuple(seq[i:i + k]) in have:
                k += 1
            n, i = n + 1, i + k
        assert a.phrases(np.array(seq, np.int32)[:, None], np.array([len(seq)])).tolist() == [n]


# ---- shards

def test_shards(spark, odd, texts):
    got = QUERIES["op3_kd_shards"](spark, SF01).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 16 and size.max() - size.min() <= 2 * got["size"].max()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    out = kd_shards.kd_shards(odd, 4).collect()
    assert len(out) == odd.count() and {(r["shard"], r["slot"]) for r in out}.__len__() == len(out)
    assert kd_shards.kd_shards(odd.limit(0), 4).count() == 0
    hot = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "same text").otherwise(
        F.concat(F.lit("other "), F.col("id"))).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"),
        F.lit(9).alias("n_chars"))
    even = kd_shards.kd_shards(hot, 4).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()["s"]
    assert even.max() < 1.25 * even.min()


# ---- pages

PAGE = """<html><head><title>T</title><script>if(a<b){x="</p>"}</script></head><body><nav><li>Menu</li></nav>
<div class="cookie-notice">We use cookies</div>%s<div id="comments"><p>Nice post</p></div><aside>Side</aside>
<form><p>Sign up</p></form><footer>&copy; Foot</footer></body></html>"""


def test_extraction(spark):
    body = '<article><header><h1>Head %d</h1></header><p>First&nbsp;&amp;   second<br>line<p>Next <b>bold</b> %d'
    rows = [(i, f"http://h.example.com/{i}", PAGE % (body % (i, i) + "</article>")) for i in range(4)]
    rows += [(10, "http://one.example.com/", PAGE % "<div><p>Plain</p>tail</div>"), (11, None, PAGE % "<main><p>M</p></main>"),
             (12, "http://h.example.com/x", None), (13, "::bad::", ""), (14, "http://h.example.com/y", "<p>cut <b"),
             (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = html_extract.html_extract(pages, ["page_id"]).collect()
    out = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    for i in range(4):
        assert out[i] == f"Head {i}\n\nFirst & second line\n\nNext bold {i}"
    assert (out[10], out[11], out[12], out[13], out[14]) == ("Plain\n\ntail", "M", "", "", "cut")
    assert html_extract.html_extract(pages.limit(0), ["page_id"]).count() == 0


def test_template_slots():
    page = "<body><div class='x'><div class='body'><div class='tip'>Always the same tip</div><p>%s</p></div></div></body>"
    path, template = html_extract.induce([page % f"text number {i} with words" for i in range(4)])
    assert path.endswith("div.body") and len(template) == 1
    assert html_extract.apply_wrapper(page % "fresh text", path, template) == "fresh text"


def test_headline_and_lead_outside_the_body_element():
    page = ("<body><div class='top'>Site</div><div class='entry'><h1>Head %d</h1><div class='lead'>Lead %d</div>"
            "<div class='entry-content'><p>%s</p></div></div><div class='end'>Same end</div></body>")
    path, template = html_extract.induce([page % (i, i, f"text {i} " * 100) for i in range(4)])
    assert path.endswith("div.entry") and not template
    assert html_extract.apply_wrapper(page % (9, 9, "fresh text"), path, template) == "Head 9\n\nLead 9\n\nfresh text"


def test_template_texts_hold_on_all_pages(spark):
    # 8 of 40 pages are sampled: on these all bylines are equal; the first p.t is constant, later ones vary
    page = ("<body><div class='x'><div class='body'><div class='by'>By %s</div><p class='t'>Always the same tip</p><h2>Part</h2>"
            "<p class='t'>text number %d with words</p></div></div></body>")
    html = spark.createDataFrame([(i, "http://h.example.com/", page % ("Ann", i)) for i in range(40)], "page_id long, url string, html string")
    first = {r["page_id"] for r in html.orderBy(F.xxhash64("html")).limit(20).collect()}
    some = [(i, "http://h.example.com/", page % ("Ann", i)) for i in first]
    least = html.where(F.col("page_id").isin(*first)).select(F.sort_array(F.collect_list(F.xxhash64("html")))[7].alias("h")).first()["h"]
    late = spark.createDataFrame([(100 + i, "http://h.example.com/", page % ("Bob", 100 + i)) for i in range(60)],
                                 "page_id long, url string, html string").where(F.xxhash64("html") > least)
    assert late.count() > 0
    pages = spark.createDataFrame(some, "page_id long, url string, html string").unionByName(late)
    out = {r["page_id"]: r["text"] for r in html_extract.html_extract(pages, ["page_id"]).collect()}
    assert len(out) == pages.count()
    assert all(t == f"By {'Ann' if i < 100 else 'Bob'}\n\nPart\n\ntext number {i} with words" for i, t in out.items())


def test_all_pages_decide_on_the_path(spark):
    # leads of early pages are equal, so these alone put the content below them; later ones vary
    page = ("<body><div class='x'><div class='entry'><div class='lead'>Lead %s</div><div class='entry-content'>"
            "<p>text number %d with words</p></div></div></div></body>")
    kind = "page_id long, url string, html string"
    early = spark.createDataFrame([(i, "http://h.example.com/", page % ("same", i)) for i in range(60)], kind)
    least = early.select(F.sort_array(F.collect_list(F.xxhash64("html")))[7].alias("h")).first()["h"]
    late = spark.createDataFrame([(100 + i, "http://h.example.com/", page % (i, 100 + i)) for i in range(40)], kind) \
        .where(F.xxhash64("html") > least)
    assert late.count() > 0
    other = spark.createDataFrame([(200 + i, "http://k.example.com/", page % ("same", i)) for i in range(20)], kind)
    pages = early.unionByName(late).unionByName(other)
    out = {r["page_id"]: r["text"] for r in html_extract.html_extract(pages, ["page_id"]).collect()}
    assert len(out) == pages.count()
    for i, t in out.items():
        lead = "" if i >= 200 else f"Lead {'same' if i < 100 else i - 100}\n\n"
        assert t == f"{lead}text number {i - 200 if i >= 200 else i} with words"


def test_pages_of_one_main_text_do_not_hide_the_others(spark):
    page = "<body><div class='x'>%s<div class='body'><p>%s</p></div></div></body>"
    kind = "page_id long, url string, html string"
    same = spark.createDataFrame([(i, "http://h.example.com/", page % (f"<!-- {i} --><div class='tip'>Tip</div>", "one text"))
                                  for i in range(40)], kind)
    least = same.select(F.sort_array(F.collect_list(F.xxhash64("html")))[7].alias("h")).first()["h"]
    more = spark.createDataFrame([(100 + i, "http://h.example.com/", page % ("<div class='tip'>Tip</div>", f"text {i}"))
                                  for i in range(12)], kind).where(F.xxhash64("html") > least)
    assert more.count() > 3
    out = {r["page_id"]: r["text"] for r in html_extract.html_extract(same.unionByName(more), ["page_id"]).collect()}
    assert len(out) == 40 + more.count()
    assert all(t == ("one text" if i < 100 else f"text {i - 100}") for i, t in out.items())


# ---- personal data

def test_rules_equal_plain_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(2)
    for _ in range(5000):
        x = "".join(rng.choice("a1.@-+ 25é_") for _ in range(rng.randint(1, 24)))
        want = [m.span() for m in email.finditer(x)]
        assert [s[1:] for s in pii.emails(x)] == want
        want = [m.span() for m in ip.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s[1:] for s in pii.rule_spans(x) if s[0] == "ip"] == want
    found = pii.rule_spans("a@b.co 4111 1111 1111 1111, 4111 1111 1111 1112 +1 (523) 555-1055 x 1.2.3.999")
    assert [k for k, _, _ in found] == ["email", "card", "phone"]


def test_personal_data(spark, odd):
    crf = pii.learn([])
    text = "Call (523) 555-1055 or mail ann@example.org about 12 apples in 1998."
    (base, every), = pii.find_spans(crf, [text])
    assert [k for k, _, _ in base] == ["email"] and ("phone", 5, 19) in every
    assert pii.mask(text, every) == "Call [PHONE] or mail [EMAIL] about 12 apples in 1998."
    out = pii.personal_data(odd, ["doc_id"], crf=crf)
    assert out.count() == odd.count()
    row = [r for r in out.collect() if r["doc_id"] == 8][0]
    assert row["n_ip"] == 1 and row["base_sha256"] == hashlib.sha256(b"ip:6:13").hexdigest()
    m = pii.masked(odd, crf=crf)
    assert m.columns == odd.columns and rows_of(m)[1]["text"] is None


def test_viterbi_equals_enumeration():
    from itertools import product
    crf = pii.learn([])
    seqs = [pii.encode("call (523) 555-1055 x", c) for c in pii.chains("call (523) 555-1055 x")]
    em = crf.weights[seqs[0]].sum(1)
    k = len(pii.TAGS)

    def score(path):
        s = em[0, path[0]] + (0 if pii._START[path[0]] else pii._NO)
        for t in range(1, len(path)):
            s += em[t, path[t]] + (crf.moves[path[t - 1], path[t]] if pii._ALLOWED[path[t - 1], path[t]] else pii._NO)
        return s
    assert tuple(crf.decode(seqs)[0]) == max(product(range(k), repeat=len(em)), key=score)


# ---- near duplicates

def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    by, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            for j in by[x]:
                common[j, i] += 1
            by[x].append(i)
    up = {i: i for i in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for (a, b), o in common.items():
        if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in texts}


def test_near_duplicates_brute_force(spark, odd, docs, texts, monkeypatch):
    got = rows_of(jaccard_join.near_duplicates(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(texts)
    # large cells, a cloud around a common passage, chains, short texts
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    common = rng.choices(vocab, k=60)
    some = {}
    for i in range(260):
        kind, base = i % 4, list(common)
        if kind == 0:
            base += rng.choices(vocab, k=rng.randint(0, 40))
        elif kind == 1:
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(60)] = rng.choice(vocab)
        elif kind == 2:
            base = rng.choices(vocab, k=rng.randint(0, 9))
        else:
            base = base[rng.randint(0, 20):] + rng.choices(vocab, k=rng.randint(0, 8))
        some[i] = " ".join(base)
    want = brute_components(some)
    frame = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    for share in (1, 1_000_000):       # every class, then none, tells the frequent shingles
        monkeypatch.setattr(jaccard_join, "FREQ_SHARE", share)
        got = rows_of(jaccard_join.near_duplicates(frame))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want


def test_rare_and_frequent_cells_of_equal_members(spark, monkeypatch):
    # each copy: SMALL texts of 85 frequent, one shared rare and 14 own shingles, linked by
    # the rare one's cell only; a smaller text that all these cells hold keeps their
    # rows in the frequent ones' cells and links to none; fillers make A and B frequent
    some, g = {}, jaccard_join.SMALL
    for copy in range(4):
        def words(kind, n):
            return [f"{kind}{copy}x{k}" for k in range(n)]
        a, b, rare = words("a", 89), words("b", 29), words("r", 1)
        made = [words(f"own{i}y", 14) + rare + a for i in range(g)] + [rare + a[:64] + b]
        made += [words(f"f{i}y", 100) + (a if i < 3 else b) for i in range(3 + g + 2)]
        some.update({1000 * copy + i: " ".join(w) for i, w in enumerate(made)})
    monkeypatch.setattr(jaccard_join, "FREQ_SHARE", 1)
    monkeypatch.setattr(jaccard_join, "FREQ_ROWS", 4 * (85 + 25))
    got = rows_of(jaccard_join.near_duplicates(spark.createDataFrame(list(some.items()), "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(some)


def test_cells_that_no_pivot_separates(spark, monkeypatch):
    """Many classes share one shingle and little else, so pivots find them all far: the
    steps must go on beyond the given pivots, and still lose no link."""
    rnd = random.Random(31)
    some = {}
    for i in range(90):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(3)]
        some[i] = " ".join(["common"] * 5 + own)
    some[200] = some[7] + " more"
    some[201] = some[60]
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    monkeypatch.setattr(jaccard_join, "PIVOTS", (1, 1))
    got = rows_of(jaccard_join.near_duplicates(spark.createDataFrame(list(some.items()), "doc_id long, text string")))
    sets = {k: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for k, w in ((k, v.split()) for k, v in some.items())}
    want = {}
    for a in sorted(sets):
        links = [b for b in sorted(sets) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
        want[a] = links[0]
    assert {k: r["component_id"] for k, r in got.items()} == want


def test_components_of_few_edges_take_few_jobs(spark):
    """The driver's memory grows with jobs, and components are found at every step."""
    rng = random.Random(3)
    frame = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(330)], "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("few-jobs", "components of few edges")
    try:
        jaccard_join.components(frame)
        jobs = len(sc.statusTracker().getJobIdsForGroup("few-jobs"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 6


def test_components_by_steps(spark, monkeypatch):
    rng = random.Random(11)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(50)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    want = {x: top(x) for a, b in edges if a != b for x in (a, b)}
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    first, rest = (spark.createDataFrame(e, "a long, b long") for e in (edges[:200], edges[200:]))
    for most in (jaccard_join.ONE_TASK, 0):      # one task, then steps
        monkeypatch.setattr(jaccard_join, "ONE_TASK", most)
        got = [tuple(r) for r in jaccard_join.components(frame)[0].collect()]
        assert len(got) == len(want) and dict(got) == want
        got = [tuple(r) for r in jaccard_join.connect(jaccard_join.components(first), rest)[0].collect()]
        assert len(got) == len(want) and dict(got) == want
        assert jaccard_join.components(frame.limit(0))[0].count() == 0


def test_copies_without_an_id_go(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (None, text), (None, text), (None, "another text with quite other words"), (2, ""), (None, ""),
            (None, "another text with quite other words")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(1, text), (2, ""), (None, "")] + [(None, "another text with quite other words")] * 2, key=str)


def test_near_duplicates_edges(spark, odd):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    assert sorted(g[2] for g in got if g[1] == 10) == [5, 5, 5, 5]
    assert all(g[2] == g[0] for g in got if g[1] == 0)
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id in (5, 6)").collect()) == [5]
    assert jaccard_join.near_duplicates(odd.limit(0)).count() == 0


def test_marks_without_letters_have_no_language():
    model = language_id.Model((("en", "some english words"), ("fr", "des mots")))
    got = model.predict(pa.array(["\u0301", "\u0301 1", "e\u0301"])).field("lang_pred").to_pylist()
    assert got[:2] == ["und", "und"] and got[2] != "und"


def test_rules_measure_very_long_runs(spark):
    text = "word " * 60 + " " * 1_000_000 + "end"
    got = rows_of(quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]))
    assert got[1]["n_words"] == 61 and got[1]["n_tokens"] > 60


# ---- byte-level BPE

def test_bpe_equals_the_library(spark, docs, texts, odd):
    import tiktoken
    enc = tiktoken.Encoding("own", pat_str=pretoken_pattern(), mergeable_ranks=read_ranks(BYTE_BPE), special_tokens={})
    got = rows_of(byte_bpe.round_trip(docs, ["doc_id"]))
    for i, t in texts.items():
        ids = enc.encode_ordinary(t)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    out = byte_bpe.encode(odd)
    back = out.select("doc_id", "text", byte_bpe.decode_udf()("token_ids").alias("b")).collect()
    assert all(bytes(r["b"]).decode() == (r["text"] or "") for r in back)
    model = byte_bpe.load(BYTE_BPE)
    for t in ("a" * 50_000, "ab" * 20_000, "=-" * 10_000):
        assert model.encode_batch([t])[0].tolist() == enc.encode_ordinary(t)


def test_rank_queue_equals_plain_merging():
    from itertools import product

    def plain(ranks, p):
        parts = [p[i:i + 1] for i in range(len(p))]
        while len(parts) > 1:
            r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if r == 1 << 60:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[x] for x in parts]
    rng = random.Random(3)
    for trial in range(60):
        ab = "ab" if trial % 2 else "abc"
        tokens = ["".join(x).encode() for n in (2, 3, 4) for x in product(ab, repeat=n)]
        vocab = [bytes([b]) for b in range(256)] + rng.sample(tokens, rng.randint(3, len(tokens)))
        rng.shuffle(vocab)
        ranks = {t: i for i, t in enumerate(vocab)}
        pieces = ["".join(rng.choices(ab, k=rng.randint(1, 40))).encode() for _ in range(20)]
        ids, at = byte_bpe.ByteBPE(ranks).merge(pieces)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain(ranks, p) for p in pieces]


# ---- quality rules

def test_quality_rules(spark, docs, texts, odd):
    got = rows_of(quality_rules.quality_rules(docs, ["doc_id"]))
    for i, t in texts.items():
        w = WORD.findall(t)
        tri = Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"], r["n_symbols"]) == (
            len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)), sum(t.count(c) for c in "#*$%&|<>"))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["kept"] and r["base_failed"])
    out = quality_rules.quality_rules(odd, ["doc_id"]).collect()
    assert len(out) == odd.count() and not any(r["kept"] for r in out)
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.keep_good(docs).count() == sum(r["kept"] for r in got.values())


# ---- pipeline

def test_pipeline_brute_force(spark, docs, texts):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs, ["doc_id"]).collect() if r["kept"]}
    one = {i for i, (n, c) in brute_components({i: texts[i] for i in kept}).items() if c == i or not n}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    clean = set()
    for i in one:
        n, hit, _ = contaminated(texts[i], items)
        if not (hit > 0 and 20 * hit >= n):
            clean.add(i)
    got = rows_of(corpus_pipeline.run(spark, SF001))
    assert set(got) == clean and all(r["round_trip"] for r in got.values())
    import tiktoken
    enc = tiktoken.Encoding("own", pat_str=pretoken_pattern(), mergeable_ranks=read_ranks(BYTE_BPE), special_tokens={})
    for i, r in got.items():
        plain = enc.decode(list(r["token_ids"]))
        assert not pii.rule_spans(plain)
        if not pii.rule_spans(texts[i]) and not re.search("[0-9@]", texts[i]):
            assert plain == texts[i]


def test_a_repeated_labelled_row_is_collected_once(spark):
    docs = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("some labelled text").alias("text"))
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    rows, share = toxicity.labelled_rows(docs, labels.select("doc_id", "toxic"))
    assert rows == [("some labelled text", 1)] and share == 1.0
    plan = quality_model.rated_rows(docs, labels.select("doc_id", F.col("quality").alias("grade")))
    assert plan[0] == ["some labelled text"]
