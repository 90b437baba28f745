import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skein.llm import langid, queries, url_rules

WORDS = {"en": "the and of that with this from have were which".split(), "de": "der die und das nicht eine auch sich über wird".split(), "fr": "les des une dans avec pour être qui sont plus".split(), "es": "los una con para como más este pero sobre entre".split()}


def test_trigrams_do_not_cross_texts():
    codes, bounds = langid.trigrams(pa.array(["abc", "", "ab", "xAbC9!d", "éé"]))
    assert np.diff(bounds).tolist() == [1, 0, 0, 4, 2] and codes[0] == langid.trigrams(pa.array(["ABC"]))[0][0]


def test_fusion(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        name = rng.choice(list(WORDS))
        rows.append((k, " ".join(rng.choices(WORDS[name], k=rng.randint(3, 30))), name, f"http://{name}{k % 3}.example.{'de' if name == 'de' else 'com'}/x"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(frame.select("text", F.col("lang").alias("language")))
    hard = [(900, "xq zv", "de", "http://de0.example.de/"), (901, None, "en", None), (902, "12 34", None, None), (903, "", "xx", "h"), (None, "the and of that", None, None), (7, "der die und das", "de", None), (905, "and the " * 30000, None, "nohost")]
    both = frame.unionByName(spark.createDataFrame(hard, frame.schema)).withColumn("language", F.lit("clash"))
    got = langid.identify(both, model, declared=F.col("lang"), address=F.col("source"))
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, r)
    right = sum(found[k].language == name for k, _, name, _ in rows)
    assert right >= 0.99 * len(rows)
    assert found[900].language == "de" and found[None].language == "en" and found[905].language == "en"
    assert all(not found[k].accepted and found[k].language is None for k in (901, 902, 903))
    kept = langid.keep_identified(both, got)
    assert kept.columns == both.columns and kept.count() == both.count() - 3
    assert langid.identify(frame.limit(0), model, declared=F.col("lang"), address=F.col("source")).count() == 0
    page = spark.createDataFrame([("<html class=x lang='DE-at'>",), ("<p>",), (None,)], "h string").select(langid.declared_language(F.col("h")).alias("d")).collect()
    assert [r.d for r in page] == ["de", None, None]


def test_texts_in_no_known_language_are_not_accepted(spark):
    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    model = langid.fit(docs.select("text", F.col("lang").alias("language")))
    others = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待",
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire",
        "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten",
        *(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(20)) for _ in range(5)),
    ]
    known = ["All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience", "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt"]
    rows = [(-1 - k, t, "en" if k % 2 else None, "src1") for k, t in enumerate(others)] + [(-100 - k, t, None, None) for k, t in enumerate(known)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    found = {r.doc_id: r for r in langid.identify(both, model, declared=F.col("lang"), address=F.col("source")).collect()}
    assert [k for k in range(len(others)) if found[-1 - k].accepted] == []
    assert [found[-100 - k].language for k in range(2) if found[-100 - k].accepted] == ["en", "de"]
    own = [r for d, r in found.items() if d >= 0]
    assert sum(r.accepted for r in own) >= 0.99 * len(own)


def held_out_accuracy(spark, declared, address):
    """Share of right languages for texts of three words, labels of which the model never sees."""
    rng = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000 and length(text) > 300").orderBy("doc_id").collect()
    hosts = {"en": "a.example.com", "de": "b.example.de", "fr": "c.example.fr", "es": "d.example.com"}
    learned, rows = [], []
    for r in docs:
        if r.doc_id % 5:
            learned.append((r.text, r.lang))
        else:
            words = r.text.split()
            at = rng.randint(0, len(words) - 4)
            said = r.lang if rng.random() < 0.8 else rng.choice(list(hosts))
            where = hosts[r.lang if rng.random() < 0.9 else rng.choice(list(hosts))]
            rows.append((r.doc_id, " ".join(words[at : at + 1]), said, where, r.lang))
    model = langid.fit(spark.createDataFrame(learned, "text string, language string"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, said string, place string, truth string")
    got = {r.doc_id: r.language for r in langid.identify(frame, model, declared=F.col("said") if declared else None, address=F.col("place") if address else None).collect()}
    return sum(got[r[0]] == r[4] for r in rows) / len(rows)


def test_each_evidence_raises_held_out_accuracy_on_short_texts(spark):
    alone, said, place, both = (held_out_accuracy(spark, d, a) for d, a in ((False, False), (True, False), (False, True), (True, True)))
    print(f"held-out accuracy: text {alone:.3f}, with declaration {said:.3f}, with address {place:.3f}, with both {both:.3f}")
    assert alone < min(said, place) and max(said, place) <= both


def test_a_document_does_not_raise_its_own_prior(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(WORDS["en"], k=12)), None, "http://big.com/") for k in range(60)] + [(100, "der und", None, "http://own.net/"), (101, "der und", None, "http://big.com/")]
    rows += [(200 + k, " ".join(rng.choices(WORDS["de"], k=12)), None, "http://de.org/") for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labelled = frame.select("text", F.when(F.col("doc_id") < 100, "en").otherwise("de").alias("language"))
    got = {r.doc_id: r.posterior for r in langid.identify(frame, langid.fit(labelled), declared=F.col("lang"), address=F.col("source")).collect()}
    # Nobody else is on own.net: its prior is that of all documents, as if it had no address.
    alone = {r.doc_id: r.posterior for r in langid.identify(frame.withColumn("source", F.when(F.col("doc_id") != 100, F.col("source"))), langid.fit(labelled), declared=F.col("lang"), address=F.col("source")).collect()}
    assert abs(got[100] - alone[100]) < 1e-9 and got[101] < got[100]


def test_clashing_names_and_repeated_rows(spark):
    rows = [(1, "the and of", "en", 1, 2), (1, "the and of", "en", 1, 2), (2, "12", "en", 1, 2), (None, None, None, 1, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, _id int, _hash int")
    found = langid.identify(frame, langid.fit(frame.select("text", F.col("lang").alias("language"))), declared=F.col("lang"))
    kept = langid.keep_identified(frame, found)
    assert kept.columns == frame.columns and [r.doc_id for r in kept.collect()] == [1, 1]


def test_rules_are_the_smallest_sets_that_pass(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(800):
        parts = sorted(rng.sample("abcdefg", rng.randint(1, 6)))
        rows.append(("http://h.org/" + "/".join(parts), set("abcde") <= set(parts) or set("fg") <= set(parts) or rng.random() < 0.05))
    got = {tuple(r.tokens): r.confidence for r in url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean"), min_count=5, min_confidence=0.8).collect()}
    tokens = [({"host:h", "host:org", *("path:" + p for p in u.split("/")[3:])}, bad) for u, bad in rows]
    names = sorted(set().union(*(t for t, _ in tokens)))
    share = sum(b for _, b in tokens) / len(tokens)
    passing = {}
    for k in range(1, 1 << len(names)):
        own = {n for j, n in enumerate(names) if k >> j & 1}
        have = [b for t, b in tokens if own <= t]
        if sum(have) >= 5 and sum(have) / len(have) >= 0.8 and sum(have) / len(have) > share:
            passing[frozenset(own)] = sum(have) / len(have)
    want = {tuple(sorted(s)): c for s, c in passing.items() if not any(o < s for o in passing)}
    assert any(len(t) > 4 for t in want) and got == want


def test_labels_from_listed_rules_and_their_precision(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labelled = url_rules.decided(pages, queries.URL_RULES).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(2)))
    test = labelled.where("fold = 1").select(F.monotonically_increasing_id().alias("page_id"), "url", "bad").cache()
    judged = url_rules.judge(test, [], url_rules.mine(labelled.where("fold = 0"))).join(test.select("page_id", "bad"), "page_id").collect()
    blocked = [r.bad for r in judged if r.verdict == "block"]
    print(f"held-out precision {sum(blocked) / len(blocked):.3f}, recall {sum(blocked) / sum(r.bad for r in judged):.3f}")
    assert sum(blocked) / len(blocked) > 0.9 and sum(blocked) == sum(r.bad for r in judged)
    assert sum(r.confidence is not None for r in queries.op9_url_filters(spark, "/root/testdata/sf0.01").collect()) > 0


def test_url_rules(spark):
    urls = ["http://a.example.com/en/1", "https://www.EXAMPLE.com/en/x?q#f", "http://shop.com", "http://shop.com/", "http://x.net/fr/9", "http://x.net/en/9", None, "no scheme", "http://h.org?x=/y", "http://bad.org/spam/77?utm=1", "ftp://notexample.com/en/"]
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate([*urls, urls[9]])], "page_id long, url string, rule string")
    labelled = [(f"http://bad.org/spam/{k}", True) for k in range(40)] + [(f"http://good.org/news/{k}", False) for k in range(60)] + [(None, True), ("http://z.org/", None)]
    mined = url_rules.mine(spark.createDataFrame(labelled, "url string, bad boolean"))
    assert mined.count() > 0 and all(r.key in r.tokens and r.confidence >= 0.8 for r in mined.collect())
    got = {r.page_id: r for r in url_rules.judge(pages, queries.URL_RULES, mined).collect()}
    assert len(got) == 12
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(11)] == [
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("shop.com", "", None, "allow"), ("shop.com", "/", "com/", "allow"), ("x.net", "/fr/9", "net/fr/", "block"),
        ("x.net", "/en/9", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("h.org", "", None, "allow"), ("bad.org", "/spam/77", None, "block"), ("notexample.com", "/en/", "com/", "allow"),
    ]
    assert url_rules.mine(spark.createDataFrame([], "url string, bad boolean")).count() == 0
    assert url_rules.judge(pages.limit(0), queries.URL_RULES, mined).count() == 0


def test_posteriors_against_plain_python(spark):
    """Text likelihood, unknown class, confusion table and smoothed address priors without the row's own share, row by row."""
    rng = random.Random(21)
    hosts = ["a.x.com", "b.x.com", "a.y.de", "solo", ""]
    rows = []
    for k in range(150):
        name = rng.choice(list(WORDS))
        rows.append((k, " ".join(rng.choices(WORDS[name], k=rng.randint(1, 6))), rng.choice([*WORDS, "xx", None]), rng.choice(hosts) or None))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labelled = spark.createDataFrame([(" ".join(rng.choices(WORDS[n], k=12)), n) for n in WORDS for _ in range(30)], "text string, language string")
    model = langid.fit(labelled)
    names, n, temper, strength, unknown = list(langid.LANGUAGES), 4, 0.3, 20.0, 1e-3
    scored = []
    for d, text, said, source in rows:
        codes, bounds = langid.trigrams(pa.array([text]))
        logs = [temper * sum(float(model[c, k]) for c in codes) for k in range(n)]
        top = max(logs)
        none = temper * len(codes) * float(model[0, n]) + np.log(unknown) - top
        logs = [x - top for x in logs]
        total = sum(np.exp(x) for x in logs) + np.exp(min(none, 700.0))
        mass = [np.exp(x) / total if len(codes) else 0.0 for x in logs]
        host = (source or "").lower()
        labels = host.split(".")
        scored.append((d, logs, none, mass, said if said in names else None, host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""))
    root = np.array([sum(s[3][k] for s in scored) for k in range(n)]) + 1.0
    root /= root.sum()
    confusion = np.array([[sum(s[3][k] for s in scored if s[4] == name) + (n - 1.0 if j == k else 1.0) for k in range(n)] for j, name in enumerate(names)])
    want = {}
    for d, logs, none, mass, said, host, domain, suffix in scored:
        prior = root
        for at, value in ((7, suffix), (6, domain), (5, host)):
            same = [s for s in scored if s[7] == suffix and (at > 6 or s[6] == domain) and (at > 5 or s[5] == host) and s[at] == value]
            counts = np.array([sum(s[3][k] for s in same) - mass[k] for k in range(n)])
            prior = (counts + strength * prior) / (counts.sum() + strength)
        fused = [logs[k] + (np.log((confusion[names.index(said), k] - mass[k]) / (confusion[:, k].sum() - mass[k])) if said else 0.0) + np.log(prior[k]) for k in range(n)]
        best = max(fused)
        total = sum(np.exp(x - best) for x in fused) + np.exp(none - (np.log(n) if said else 0.0) - best)
        want[d] = names[int(np.argmax(fused))], 1 / total
    got = {r.doc_id: r for r in langid.identify(frame, model, declared=F.col("lang"), address=F.col("source")).collect()}
    for d, (name, p) in want.items():
        if got[d].evidence:
            assert got[d].language == name and abs(got[d].posterior - p) < 1e-5, (d, got[d], name, p)


def test_pages_are_judged_by_markup_and_address_too(spark):
    got = queries.pages_language(spark, "/root/testdata/sf0.01").collect()
    marked = {r.page_id: r.d for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", langid.declared_language(F.col("html")).alias("d")).collect()}
    assert len(got) == len(marked) and sum(r.language == marked[r.page_id] for r in got) >= 0.98 * len(got)
