"""Near copies, leaks, quality, language, tokens, licences and pages against brute force, with the awkward cases."""

import math
import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from parcelry.llm import html, langid, licenses, quality, queries, simhash, tokencount
from parcelry.llm.decontam import ItemAutomaton, build_automata, plain, scan_benchmark

DOCS = "doc_id bigint, text string"
AWKWARD = [(101, None), (102, ""), (103, "\n \t"), (104, "word " * 30000), (105, "same text here now"), (105, "same text here now"), (None, "no id at all"), (106, "ÀÉ ß x 漢字"), (107, "one")]


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = list(AWKWARD)
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 20, 400]))]
        rows.append((k, " ".join(base)))
        for j in range(3):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((1000 + 10 * k + j, "  ".join(near)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    want = [(i, fingerprint(t)) for i, t in rows]
    linked = [(a, b) for a, b in combinations({f for _, f in want}, 2) if (a ^ b).bit_count() <= 2]
    root = roots({f for _, f in want}, linked)
    least = {}
    for i, f in want:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    show = sorted((str(i), f"{f:016x}", least.get(root[f])) for i, f in want)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == show
    assert linked


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_are_brute_force(spark, bits):
    """Fingerprints around one centre, so that lists are long, and some far from it."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "_fp bigint")
    want = {tuple(sorted((simhash.signed(a), simhash.signed(b)))) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= bits}
    got = [(r["a"], r["b"]) for r in simhash.links(df, bits).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_the_tally_drops_pairs(spark):
    """Five equal bytes meet once, six meet six times: the pair below the guaranteed minimum isn't verified."""
    met = simhash.links(spark.createDataFrame([(0,), (0x010101,), (0x0101,)], "_fp bigint"), 2)
    assert {(r["a"], r["b"]) for r in met.collect()} == {(0, 0x0101), (0x0101, 0x010101)}
    assert "_met" in met._jdf.queryExecution().optimizedPlan().toString() or ">= 6" in met._jdf.queryExecution().optimizedPlan().toString()


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, **{k: 100 for k in range(100, 160)}}
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    lone = simhash.near_duplicates(spark.createDataFrame([(None, "a b c")], DOCS)).first()
    assert lone["component_id"] is None
    wide = spark.createDataFrame([(1, "a b c", "old", 3, 4, 5)], DOCS + ", fingerprint string, _fp int, _id int, _root int")
    got = simhash.near_duplicates(wide).first().asDict()
    assert got == {"doc_id": 1, "_fp": 3, "_id": 4, "_root": 5, "fingerprint": f"{fingerprint('a b c'):016x}", "component_id": 1}


def leaks(text, items, window=10):
    words = plain(text).split()
    hit, found = set(), set()
    for name, t in items:
        own = plain(t).split()
        n = min(window, len(own))
        for w in {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else ():
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) == w:
                    hit |= set(range(k, k + n))
                    found.add(name)
    return len(words), len(hit), sorted(found)


def leak_case(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcd")
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 4, 9, 10, 11, 25])))) for k in range(12)] + [(50, None), (51, "..."), (7, "d c b a d c b a d c b")]
    docs = [(k, "".join(word() + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(60)))) for k in range(30)]
    docs += [(100 + k, f"Zz {t.upper()}! zz") for k, (_, t) in enumerate(items) if t]
    return docs + AWKWARD, items


@pytest.mark.parametrize("block", [10**6, 20])
def test_leaks_are_brute_force(spark, block):
    for seed in (1, 2):
        docs, items = leak_case(seed)
        got = scan_benchmark(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"), block_words=block).collect()
        named = [(str(i), t) for i, t in items]
        show = lambda i, x: (str(i), x[0], x[1], ",".join(x[2]))
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["hit_items"])) for r in got) == sorted(show(i, leaks(t, named)) for i, t in docs)


def test_each_automaton_is_built_once(spark):
    """Fifty blocks, fifty automata; the items of all of them, a long one in pieces, are found."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    items = [(str(k), " ".join(rng.choice(words) for _ in range(20 if k else 700))) for k in range(300)]
    table = spark.createDataFrame(items, "item_id string, text string")
    automata, blocks = build_automata(table, "item_id", "text", 10, 140)
    assert automata.count() == blocks and 40 <= blocks <= 51 and automata.select("block").distinct().count() == blocks
    docs = [(k, "before " + " ".join(t.split()[-12:]) + " after") for k, (_, t) in enumerate(items[:4])] + AWKWARD
    got = scan_benchmark(spark.createDataFrame(docs, DOCS), table.limit(12), block_words=140).collect()
    want = [(str(i), *leaks(t, items[:12])) for i, t in docs]
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["hit_items"]) for r in got) == sorted(want)


def test_long_matches_need_no_alignment():
    rng = random.Random(9)
    items = [(str(k), [b"%d" % rng.randrange(3) for _ in range(40)]) for k in range(5)]
    automaton = ItemAutomaton(items, 10)
    for _ in range(50):
        words = [b"%d" % rng.randrange(3) for _ in range(80)]
        words[20:45] = items[rng.randrange(5)][1][3:28]
        hits, found = automaton.scan(words)
        covered = {p for a, b in hits for p in range(a, b)}
        n, h, names = leaks(b" ".join(words).decode(), [(i, b" ".join(w).decode()) for i, w in items])
        assert len(covered) == h and sorted(found) == names


def test_spans_are_removed(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = [(1, f"Keep this much. {item}; and this tail, " + "more words here " * 5), (2, f"x {item} y"), (3, "nothing é")]
    got = {r["doc_id"]: r for r in scan_benchmark(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert got[1]["clean_text"] == "Keep this much. ; and this tail, " + "more words here " * 5
    assert got[2]["coverage"] > 0.5 and got[2]["clean_text"] == "x  y" and got[3]["clean_text"] == "nothing é"
    none = scan_benchmark(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id bigint, text string"))
    assert {r["n_hit"] for r in none.collect()} == {0}
    assert scan_benchmark(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, item)], "item_id bigint, text string")).count() == 0


def counts(text):
    text = text or ""
    space = " \t\n\x0b\x0c\r"
    words = text.encode().split()
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    again = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if x.strip(space)]
    return len(words), sum(c not in space for c in text), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_quality_counts():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a ", "b ", "é ", "#", "|x ", "\n", "\t"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    for t in [*texts, None, "", "x y z x y z", "漢字 *"]:
        assert quality.text_counts(t)[:5] == counts(t)


def test_binomial_tail():
    for n, rate in ((7, 0.3), (50, 0.02), (400, 0.9)):
        for x in range(-1, n + 1, max(1, n // 9)):
            want = sum(math.comb(n, k) * rate**k * (1 - rate) ** (n - k) for k in range(x + 1))
            assert quality.binomial_tail(x, n, rate) == pytest.approx(want, rel=1e-9, abs=1e-14)
    assert quality.binomial_tail(10**6, 10**8, 0.011) < 1e-9


def labelled(spark, n=1500):
    rng = random.Random(6)
    rows, marks = [], []
    for k in range(n):
        bad = k % 3 == 0
        words = [f"w{rng.randrange(10**6)}" + ("###" if bad and rng.random() < 0.9 else "") for _ in range(60)]
        rows.append((k, "en", " ".join(words)))
        marks.append((k, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int")


def test_cutoffs_spare_good_documents(spark):
    docs, marks = labelled(spark)
    stats = quality.add_counts(docs, keep_text=False)
    cutoffs = quality.fit_cutoffs(stats, marks)
    got = quality.judge(stats, cutoffs).join(marks, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in got.collect()}
    assert kept[1] >= 0.95 and kept[0] < 0.05


def plain_ladder(stats, marks, allowed=0.05, error=0.05, enough=0.99, least=100):
    """Cutoffs by stratum, document by document. stats: rows of counts with lang; marks: id to quality."""
    figure = {"symbols": lambda r: r["n_symbols"] / max(r["n_words"], 1), "repeats": lambda r: r["n_repeat_words"] / max(r["n_words"], 1), "dup_lines": lambda r: r["n_dup_lines"] / max(r["n_lines"], 1), "capitals": lambda r: r["n_capitals"] / max(r["word_chars"], 1)}
    held = [r for r in stats if r["doc_id"] in marks and r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"]]
    large = {x for x in {r["lang"] for r in held} if sum(r["lang"] == x and marks[r["doc_id"]] == 1 for r in held) >= least}
    out = {}
    for stratum in [*large, "rest"]:
        own = [r for r in held if (r["lang"] if r["lang"] in large else "rest") == stratum]
        good, bad = [r for r in own if marks[r["doc_id"]] == 1], [r for r in own if marks[r["doc_id"]] != 1]
        gone = lambda r, at: any(k is not None and figure[n](r) > quality.RULES[n][1][k] for n, k in at.items())
        passed = 0
        while passed < quality.STEPS and good:
            x = sum(gone(r, dict.fromkeys(figure, passed)) for r in good)
            if sum(math.comb(len(good), k) * allowed**k * (1 - allowed) ** (len(good) - k) for k in range(x + 1)) > error / (len(large) + 1):
                break
            passed += 1
        at = dict.fromkeys(figure, passed - 1 if passed else None)
        best = sum(gone(r, at) for r in bad)
        for n in reversed(figure):
            for k in [None, *range(passed)]:
                if sum(gone(r, at | {n: k}) for r in bad) >= enough * best:
                    at[n] = k if best else None
                    break
        if own:
            out[stratum] = {n: None if k is None else quality.RULES[n][1][k] for n, k in at.items()}
    return out, large, lambda r, cut: [n for n in figure if cut.get(n) is not None and figure[n](r) > cut[n]]


def test_ladder_is_brute_force(spark):
    """One large language, two small ones, a null one; symbols tell bad documents, and some good ones repeat themselves."""
    rng = random.Random(11)
    rows, marks = [(10**6, None, None), (10**6 + 1, "xx", "")], {10**6: 1}
    for k in range(700):
        bad = k % 4 == 0
        words = [f"w{rng.randrange(10**6)}" + ("##" if bad and rng.random() < 0.35 else "") for _ in range(60)]
        if rng.random() < 0.01:
            words[40:52] = words[20:32]
        rows.append((k, "en" if k < 400 else rng.choice(["de", "fr", None]), "\n".join(words) if k % 9 == 0 else " ".join(words)))
        marks[k] = 0 if bad else 1
    stats = quality.add_counts(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), keep_text=False).cache()
    cutoffs = quality.fit_cutoffs(stats, spark.createDataFrame(list(marks.items()), "doc_id bigint, quality int"))
    want, large, broken = plain_ladder([r.asDict() for r in stats.collect()], marks)
    got = {r["_stratum"].removeprefix("s"): {n: r[n] for n in quality.RULES} for r in cutoffs.collect()}
    assert got == want and large == {"en"} and any(want["en"].values()) and any(want["rest"].values())
    assert all(r["n_certified"] > 0 for r in cutoffs.collect())
    for r in quality.judge(stats, cutoffs).collect():
        failed = broken(r, want[r["lang"] if r["lang"] in large else "rest"])
        base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert (r["base_failed"], r["failed_rules"], r["kept"]) == (base, failed, not base and not failed)


def test_few_labels_reject_nothing(spark):
    docs, marks = labelled(spark, 60)
    stats = quality.add_counts(docs.unionByName(spark.createDataFrame([(10**6, None, None), (None, "xx", "")], docs.schema)))
    out = quality.judge(stats, quality.fit_cutoffs(stats, marks.unionByName(marks.limit(5))))
    assert out.filter("kept = base_failed").count() == 0 and out.count() == 62
    nothing = quality.judge(stats.limit(0), quality.fit_cutoffs(stats.limit(0), marks))
    assert nothing.count() == 0
    clash = quality.judge(stats.withColumn("_stratum", F.lit(7)).withColumn("_base", F.lit(8)), quality.fit_cutoffs(stats, marks)).first()
    assert clash["_stratum"] == 7 and clash["_base"] == 8


def test_the_smallest_tables_certify_something(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")
    cutoffs = quality.fit_cutoffs(quality.add_counts(docs, keep_text=False), spark.read.parquet(f"{d}/labels.parquet"))
    assert cutoffs.filter("symbols IS NOT NULL").count() >= 1


def test_language_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    got = queries.op3_language(spark, d).join(truth, "doc_id").filter("held_out AND lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_language_mixtures_and_missing_texts(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("n_chars > 600")
    model = langid.train(docs)
    some = {r["lang"]: r["text"] for r in docs.groupBy("lang").agg(F.first("text").alias("text")).collect()}
    rows = AWKWARD + [(1, some["de"] + " " + some["fr"]), (2, "123 --- 456"), (3, some["es"])]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, DOCS), model).collect()}
    assert {"de", "fr"} <= set(got[1]["mixture"]) and sum(got[1]["mixture"].values()) == pytest.approx(1, abs=1e-6)
    assert [got[k]["lang_pred"] for k in (2, 101, 102, 103)] == ["und"] * 4 and got[2]["score"] == 0
    assert got[3]["lang_pred"] == "es" and got[104]["lang_pred"] in model.langs
    nobody = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, DOCS), nobody).collect()} == {"und"}


def test_language_of_copies_is_learned(spark):
    copies = [(k, "zu", "umuntu ngumuntu ngabantu bonke abantu bazalwa bekhululekile") for k in range(4000)]
    others = [(k, "en", f"the house number {k} stands by the river and the road {k * 7}") for k in range(200)]
    docs = spark.createDataFrame(copies + others, "doc_id long, lang string, text string")
    model = langid.train(docs, sample_docs=50)
    got = langid.identify(docs, model).filter("doc_id < 200")
    assert got.filter("lang_pred = 'zu'").count() == 200 and got.filter("lang_pred = 'en'").count() == 200


def test_language_doesnt_depend_on_neighbours(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    model = langid.train(docs)
    texts = [langid.letters(r["text"]) for r in docs.collect()]
    together = langid.infer(model, texts)
    alone = [langid.infer(model, [t])[0] for t in texts]
    assert [t[0] for t in together] == [a[0] for a in alone]
    assert [t[1] for t in together] == pytest.approx([a[1] for a in alone], abs=1e-3)


def reference_count(vocabulary, word):
    from tokenizers import Tokenizer, models

    return len(Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=any(p == "<0x00>" for p, _ in vocabulary))).encode(tokencount.MARK + word, add_special_tokens=False).ids)


def test_token_counts_equal_the_tokenizer():
    rng = random.Random(7)
    for case in range(30):
        pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 5))) for _ in range(25)}
        score = (lambda: -float(rng.randrange(1, 4))) if case % 2 else (lambda: -rng.random() * 5)
        vocabulary = [("<unk>", 0.0)] + [(p, score()) for p in sorted(pieces)]
        if case % 3 == 0:
            vocabulary += [(f"<0x{b:02X}>", -9.0) for b in range(256)]
        counter = tokencount.PieceCounter(vocabulary[1:])
        low = min(s for _, s in vocabulary) - tokencount.UNKNOWN_COST
        counter.unknown = low
        for _ in range(20):
            word = "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 12)))
            assert counter.word(word) == reference_count(vocabulary, word), (vocabulary, word)
        word = "".join(rng.choice("abcdé") for _ in range(5000))
        assert counter.text(word) == counter.text(f" {word}\n") == reference_count(vocabulary, word)
        assert word.encode() not in counter.known


def test_token_counts_of_whole_texts(spark):
    vocabulary = tokencount.read_vocabulary(queries.VOCABULARY)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(spark.createDataFrame(AWKWARD, DOCS), vocabulary).collect()}
    full = [("<unk>", 0.0), *vocabulary]
    assert got[101] == got[102] == got[103] == 0
    assert got[105] == sum(reference_count(full, w) for w in "same text here now".split())
    assert got[104] == 30000 * reference_count(full, "word")
    assert got[106] == sum(reference_count(full, w) for w in "ÀÉ ß x 漢字".split(" "))
    assert tokencount.count_tokens(spark.createDataFrame([], DOCS), vocabulary).count() == 0


def test_licences(spark):
    mit = licenses.KNOWN["MIT"][0]
    rows = AWKWARD + [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.replace(". ", ".\n\n").replace('"', "'").upper()),
        (2, "prose\n  Licensed under the Apache Licence, version 2.0\nmore\nReleased under the MIT License."),
        (3, mit + " but more"),
        (4, licenses.KNOWN["BSD-2-Clause"][0].replace("1. ", "1) ")),
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1]["license"] == "MIT" and got[4]["license"] == "BSD-2-Clause"
    assert got[2]["license"] is None and got[2]["line_licenses"] == "Apache-2.0,MIT"
    assert got[3]["license"] is None and got[101]["digest"] is None and got[105]["line_licenses"] == ""
    assert licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).count() == len(rows)
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(5, mit, 1, 2, "x")], DOCS + ", _t1 int, _line int, head string")
    assert licenses.scan_licenses(clash).first().asDict() | {"digest": ""} == {"doc_id": 5, "_t1": 1, "_line": 2, "head": "x", "digest": "", "license": "MIT", "line_licenses": "MIT"}


def test_licence_lines_are_brute_force(spark):
    """Every line of the documents in its canonical form, against the known ones, without the test of its first words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    known = {r["digest"]: r["license"] for r in licenses.known_digests(spark).collect()}
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.sha2(licenses.canonical(F.col("line")), 256).alias("d")).filter(F.col("line") != "")
    want = {}
    for r in lines.collect():
        if r["d"] in known and r["d"] != "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855":
            want.setdefault(r["doc_id"], set()).add(known[r["d"]])
    got = {r["doc_id"]: r["line_licenses"] for r in licenses.scan_licenses(docs).collect()}
    assert want and {i: ",".join(sorted(want.get(i, ()))) for i in got} == got


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="menu-open">
<header><h1>Site</h1><ul><li><a href=/>Home</a></li></ul></header><nav><a href=/a>A</a></nav><div id="cookie-notice"><p>We use cookies, many, many.</p></div>
<div class="wrap"><article class="post"><header><h1>The   title</h1></header><p>First,&nbsp;with <b>bold</b>ness &lt;tag&gt; and a <a href="x>y">link</a>,<br>then more.
<p>Second &#233;&amp;c.<ul><li>One point<li>Two points</ul><blockquote>Quoted</blockquote><aside><p>Side, note.</p></aside><form><p>Your mail</p></form><!-- <p>gone</p> -->
<div class="ad">Buy, buy, buy this now.</div><p>Third.</p></article><div class="sidebar"><p>Other, things, to read, here and there.</p></div><section id="comments"><p>Reader, says, a lot of things, here.</p></section></div>
<footer><p>&copy; us, them, all.</p></footer></body></html>"""


def test_main_text_of_a_page():
    assert html.main_text(PAGE) == "The title\nFirst, with boldness <tag> and a link, then more.\nSecond é&c.\nOne point\nTwo points\nQuoted\nThird."


def test_main_text_without_article_element():
    body = "".join(f"<p>Sentence number {k}, with some commas, and enough words to count as prose here.</p>" for k in range(4))
    page = f"<body><div class=nav><a href=1>One</a><a href=2>Two</a></div><ul><li><a>Aaaa</a><li><a>Bbbb</a><li><a>Cccc</a></ul><div><h2>Head</h2>{body}</div><div class='related'><p>More, of, this.</p></div>"
    lines = html.main_text(page).split("\n")
    assert lines[0] == "Head" and len(lines) == 5
    assert html.main_text("Just text &amp; no tags") == "Just text & no tags"


def sentences(n, tag="p"):
    return "".join(f"<{tag}>Sentence number {k}, with some commas, and enough words to count as prose here.</{tag}>" for k in range(n))


def test_the_score_decides_between_containers():
    """No article element and no telling class: the container with the paragraphs wins, however deep; short lists and teasers lose."""
    teaser = "<div><div><p>Short.</p></div><div><p>Also short, this.</p></div></div>"
    page = f"<body>{teaser}<div><div><div><section>{sentences(6)}</section></div></div></div>{teaser}</body>"
    assert html.main_text(page).split("\n") == [f"Sentence number {k}, with some commas, and enough words to count as prose here." for k in range(6)]
    two = f"<article>{sentences(1)}</article><article><div>{sentences(5)}</div></article>"
    assert len(html.main_text(f"<body><div>{two}</div></body>").split("\n")) >= 5


def test_a_badly_named_article_is_kept():
    assert len(html.main_text(f'<body><nav><a>x</a></nav><div class="post-share">{sentences(4)}</div></body>').split("\n")) == 4
    assert html.main_text(f'<body><div id="main">{sentences(2)}</div><div class="comments">{sentences(9)}</div></body>').count("\n") == 1


def test_svg_and_formulas():
    assert html.main_text('<article><svg class="i"/><p>Text of the article</p></article>') == "Text of the article"
    assert html.main_text("<article><svg><text>no</text></svg><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>") == "So x=1 holds"


def test_nesting_costs_time_in_proportion():
    import time

    def took(n):
        start = time.perf_counter()
        assert html.main_text("<div>" * n + "deep, and deeper" + "</div>" * n) == "deep, and deeper"
        assert html.main_text("<div><ul>" * n + "<li>one</li>" * n) != ""
        return time.perf_counter() - start

    took(500)
    assert took(8000) < 3


def test_points_by_hand():
    """A paragraph's points, all to the parent, half to the next, a third of it above; links discount."""
    assert html.points("a, b, c", 0) == pytest.approx(3 + 0.07) and html.points("x" * 1000, 500) == pytest.approx(2.0)


@pytest.mark.parametrize("page", [None, "", "<html></html>", "<p", "<script>", "<nav><p>x</p></nav>", "<!--"])
def test_pages_without_text(page):
    assert html.main_text(page) == ""


def test_pages_that_break_off():
    assert html.main_text("<article><p>Whole. <p>Half of a sent") == "Whole.\nHalf of a sent"
    assert html.main_text('<article><p>Text<a href="unclosed>more</a>').startswith("Text")
    assert html.main_text("<p>" * 2000 + "deep") == "deep"


def test_extract_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (2, "v", None, 4), (3, "w", "<p>a</p>", 5)], "page_id bigint, url string, html string, n_chars int")
    got = {r["page_id"]: r for r in html.extract_main_text(pages).collect()}
    assert got[2]["main_text"] == "" and got[3]["n_chars"] == 1 and got[1]["url"] == "u"
    assert html.extract_main_text(pages.limit(0)).count() == 0


def test_names_decide_nothing_by_themselves():
    prose = "".join(f"<p>Sentence {k}, with commas, and words enough to read as prose.</p>" for k in range(6))
    lines = [f"Sentence {k}, with commas, and words enough to read as prose." for k in range(6)]
    for name in ("wrapper has-sidebar", "wrapper sidebar", "page-with-comments", "no-footer"):
        assert html.main_text(f'<body><div class="{name}">{prose}</div><p>Copyright</p></body>').split("\n")[:6] == lines
    inner = html.main_text(f'<article><h1>Title</h1><div class="text-sidebar">{prose}</div></article>').split("\n")
    assert inner == ["Title", *lines]
    assert html.main_text(f'<article>{prose}<div class="share"><p>Share this, if you like.</p></div></article>').split("\n") == lines


def test_links_between_paragraphs_stay():
    links = "".join(f'<li><a href="{k}">source {k}</a></li>' for k in range(3))
    assert html.main_text(f"<article><p>First, of two.</p><ul>{links}</ul><p>Second, of two.</p></article>").split("\n") == ["First, of two.", "source 0", "source 1", "source 2", "Second, of two."]
    assert html.main_text(f"<article><p>First, of two.</p><p>Second, of two.</p><ul>{links}</ul></article>").split("\n") == ["First, of two.", "Second, of two."]


def test_columns_of_any_name_stay(spark):
    names = "doc_id bigint, text string, `a.b` string, _letters string, _text string"
    docs = spark.createDataFrame([(1, "Some words in a text.", "x", "y", "z"), (2, None, "x", "y", "z")], names)
    model = langid.train(spark.createDataFrame([("words in a text", "en"), ("unas palabras", "es")], "text string, lang string"))
    for got in (
        langid.identify(docs, model),
        tokencount.count_tokens(docs, [("▁", -1.0), ("a", -2.0)]),
        quality.add_counts(docs),
        quality.add_counts(docs, keep_text=False),
        html.extract_main_text(docs.withColumnRenamed("text", "html")),
    ):
        assert [(r["a.b"], r["_letters"], r["_text"]) for r in got.collect()] == [("x", "y", "z")] * 2
