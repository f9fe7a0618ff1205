"""Quality rules, decontamination, URL filter and chat: against SQL and hand-made cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import chat, decontaminate, quality, queries, urlfilter

from ..oracle import frame, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(frame(queries.ORACLES[name], sf))


DOC = "doc_id long, text string, __row string, words string"
LONG = " ".join(f"w{i}" for i in range(30_000))
TEXTS = [None, "", " \n\t ", "a b c", "one two three four five one two three four five", "x\nx\n x\n\nx", LONG, "É# $ | <p>", "The The\x0bThe"]


def frame_of(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "r", "w") for i, t in enumerate(texts)], DOC)


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 2000 else set()
    rep = {p for i, g in enumerate(grams) if g in many for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_quality_cases(spark):
    d = frame_of(spark, [*TEXTS, TEXTS[4]])
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.apply_rules(d).collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate([*TEXTS, TEXTS[4]])}
    assert quality.apply_rules(d.limit(0)).count() == 0
    kept = quality.filter_documents(frame_of(spark, ["this is the text of a page that has many words and no junk in it", "### $$$ %%% " * 9]))
    assert [r.doc_id for r in kept.collect()] == [0] and kept.columns == d.columns
    assert quality.apply_rules(d.withColumn("doc_id", F.lit(None).cast("long"))).count() == len(TEXTS) + 1


def bench(spark, *texts):
    return spark.createDataFrame([(i * 7, t) for i, t in enumerate(texts)], "item_id long, text string")


ITEM = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda"


def brute_hits(texts, items):
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for i, item in items:
            b = words(item)
            n = min(10, len(b))
            for k in range(len(b) - n + 1) if n else []:
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_cases(spark, monkeypatch):
    texts = [None, "", "x " + ITEM.upper() + " y", "alpha beta gamma delta epsilon zeta eta theta iota", "Éa b", "say short ONE now", ITEM + ". " + ITEM, "x" * 200_000]
    d = frame_of(spark, [*texts, texts[2]])
    b = bench(spark, ITEM, None, "", "short one", ITEM, "éa b", "...")
    items = [(r.item_id, r.text) for r in b.collect()]
    want = brute_hits([*texts, texts[2]], items)
    for most, sent in ((50_000, 9), (0, 9), (0, 0)):  # the set in the row, the broadcast set, the exchange
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST", sent)
        monkeypatch.setattr(decontaminate, "MAX_WINDOWS", sent)
        got = decontaminate.find_contamination(d, b, max_set=most).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == want
        clean = decontaminate.drop_contaminated(d, b, max_set=most)
        assert {r.doc_id for r in clean.collect()} == {i for i, w in enumerate(want) if not w[4]} and clean.columns == d.columns
    assert decontaminate.find_contamination(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(d, b.limit(0)).count() == d.count()
    assert decontaminate.find_contamination(d.limit(0), b).count() == 0
    for most in (50_000, 0):
        cut = {r.doc_id: r.text for r in decontaminate.remove_spans(d, b, max_set=most).collect()}
        assert cut[2] == "x  y" and cut[5] == "say  now" and cut[0] is None and cut[3] == texts[3]
    assert decontaminate.find_contamination(decontaminate.remove_spans(d, b), b).where("contaminated").count() == 0


def test_a_benchmark_of_many_windows(spark):
    """300,000 windows, beyond the set in the row; a passage that a third of all documents hold."""
    n = 300
    items = [" ".join(f"i{i}w{k}" for k in range(1010)) for i in range(n)]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    cut = lambda i, at, size: " ".join(items[i].split()[at : at + size])
    texts = [f"start {cut(7, 100, 12)} end" for _ in range(30)] + [f"calm text {k} {cut(k, 5 * k, 9)}" for k in range(30)] + [f"x {cut(k, k, 10)} y {cut(k + 1, 0, 25)}" for k in range(30)] + [None]
    d = frame_of(spark, texts)
    assert decontaminate.windows(b).count() == 300_300 > decontaminate.MAX_SET
    hits = [12] * 30 + [0] * 30 + [35] * 30 + [0]
    per = [["7"]] * 30 + [[]] * 30 + [sorted([str(k), str(k + 1)]) for k in range(30)] + [[]]
    found = decontaminate.find_contamination(d, b)
    plan = found._jdf.queryExecution().toString()
    assert not [x for x in plan.split("\n") if "Generate" in x and "__row" in x] and "Python" not in plan
    got = found.orderBy("doc_id").collect()
    assert [r.n_hit for r in got] == hits
    assert [r.items_sha256 for r in got] == [hashlib.sha256(",".join(p).encode()).hexdigest() for p in per]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()) == [*range(30, 60), 90]


def test_url_cases(spark):
    urls = [None, "", "no scheme", "http://Sub.Example.COM/en/77?x", "https://a.example.net/de/81#t", "https://b.net/de/1", "http://x.org/es/", "ftp://casino-win.example.org?q=/", "http://notexample.com/en/7", "https://casino-win.example.com/en/7", "http://com", "a://b://c/d"]
    p = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[3]])], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(p, urlfilter.entries(spark)).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == got[12] == ("sub.example.com", "/en/77", "example.com/en/7", "allow")
    assert got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("net/de/", "allow") and got[6][2:] == ("org/es/", "block")
    assert got[7] == ("casino-win.example.org", "", None, "block") and got[8][2:] == ("com/en/", "block")
    assert got[9][2:] == ("example.com/en/7", "allow") and got[10][3] == "allow" and got[11][:2] == ("b:", "//c/d")
    assert urlfilter.judge(p.limit(0), urlfilter.entries(spark)).count() == 0
    assert {r.verdict for r in urlfilter.judge(p, urlfilter.entries(spark).limit(0)).collect()} == {"allow"}


def test_listed_urls_are_canonical(spark):
    urls = ["http://me@Casino-Win7.example.com:8080/x", "http://casino-win7.example.com.:80", "http://a.b.casino-win.example.net./", "http://casino-win99.example.com/", "http://me@x.org:80/es/1"]
    p = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(p, urlfilter.entries(spark)).collect()}
    # a rule looks at the host as it stands, so a port keeps it from fitting
    assert got == {0: (None, "block"), 1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow")}


def test_bloom_passes_every_entry_and_few_others(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"))
    bits = urlfilter.bloom(keys, 200).scalar()
    passed = lambda k: k.where(urlfilter.passes(F.col("key"), bits, 200)).count()
    assert passed(keys) == 3000
    assert passed(spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("key"))) < 400
    listed = urlfilter.entries(spark, (), keys.select(F.col("key").alias("host"), F.lit("").alias("path")))
    u = spark.range(5000).select(F.concat(F.lit("http://a.h"), "id", F.lit("/x")).alias("url"), F.col("id").alias("page_id"))
    assert urlfilter.judge(u, listed).where("verdict = 'block'").count() == 3000


def test_one_url_of_many_rows_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_BROADCAST", 10)
    listed = spark.range(400).select(F.lit("hot.org").alias("host"), F.concat(F.lit("/"), F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("path"))
    u = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("http://a.hot.org/xx")).when(F.col("id") % 3 == 1, F.lit("http://a.cold.org/xx")).alias("url")).withColumnRenamed("id", "page_id")
    got = urlfilter.judge(u, urlfilter.entries(spark, (), listed)).groupBy("host", "verdict").count().collect()
    assert {(r.host, r.verdict): r["count"] for r in got} == {("a.hot.org", "block"): 1000, ("a.cold.org", "allow"): 1000, ("", "allow"): 1000}
    long = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "hot.org/" + "x" * 100_000)], "page_id long, url string")
    assert urlfilter.judge(long, urlfilter.entries(spark, (), listed)).first().verdict == "block"


CONV = "conv_id long, turn long, role string, text string, pos string"


def test_chat_cases(spark):
    t = lambda c, *texts: [(c, i, ["user", "assistant"][i % 2], x, "p") for i, x in enumerate(texts)]
    rows_ = t(1, "a", "b") + t(2, "a", "b", "c") + t(3, "a", "b", "c") + t(4, "a", "x") + t(5, None, "b") + t(6, "") + [(None, 0, None, None, "p")] + [(8, 0, "user", "s", "p")] * 3
    rows_ += [(9, i, "user", f"m{i}", "p") for i in range(700)]
    got = {(r.conv_id, r.part): r for r in chat.render(spark.createDataFrame(rows_, CONV)).collect()}
    assert {k[0] for k in got} == {2, 4, 5, 6, 8, 9} | ({None} if (None, 0) in got else set())
    assert got[2, 0].copies == 2 and got[2, 0].text == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in (("user", "a"), ("assistant", "b"), ("user", "c")))
    assert got[8, 0].n_turns == 3 and [got[9, k].n_turns for k in range(3)] == [256, 256, 188] and got[9, 2].first_turn == 513
    assert chat.render(spark.createDataFrame([], CONV)).count() == 0
    long = chat.render(spark.createDataFrame([(1, 0, "user", "y" * 2_000_000, "p")], CONV)).first()
    assert len(long.text) > 2_000_000


def test_chat_ids_of_any_type(spark):
    rows_ = [(c, i, "user", x, "p") for c, xs in (("abc", "st"), ("b", "stu"), (None, "v"), ("", "w")) for i, x in enumerate(xs)]
    d = spark.createDataFrame(rows_, CONV.replace("conv_id long", "conv_id string"))
    assert sorted((r.conv_id or "-", r.n_turns) for r in chat.render(d).collect()) == [("-", 1), ("-", 1), ("b", 3)]
    day = d.withColumn("conv_id", F.when(F.col("conv_id") == "b", F.lit("2020-01-01")).cast("date"))
    assert {(str(r.conv_id), r.n_turns) for r in chat.render(day).collect()} == {("2020-01-01", 3), ("None", 4)}


def test_chat_repeated_turn_numbers(spark):
    """One conversation with a third of all rows, all of turn 0, many of them equal."""
    rows_ = [(1, 0, "user", f"t{i % 40}", "p") for i in range(600)] + [(1, 1, "user", "end", "p"), (1, None, None, None, "p")]
    rows_ += [(2 + i, k, "user", f"{i} {k}", "p") for i in range(40) for k in range(3)]
    d = spark.createDataFrame(rows_, CONV)
    whole, cut = chat.positions(d), chat.positions(d, hot=7)
    assert cut.groupBy("conv", "blk", "sub").count().agg(F.max("count")).first()[0] <= 24
    order = lambda p: [(r.pos, r.n, r.role, r.text, r.h1, r.h2) for r in p.where("conv.id = 1").orderBy("pos").collect()]
    assert order(cut) == order(whole) and len(order(cut)) == 602
    assert rows(chat.maximal(cut).select("conv.id", "copies").toPandas()) == rows(chat.maximal(whole).select("conv.id", "copies").toPandas())


def test_chat_blocks_do_not_matter(spark, sf):
    d = spark.read.parquet(f"{sf}/conversations.parquet")
    one = {r.conv: r.copies for r in chat.maximal(chat.positions(d, 256)).collect()}
    assert {r.conv: r.copies for r in chat.maximal(chat.positions(d, 2)).collect()} == one
