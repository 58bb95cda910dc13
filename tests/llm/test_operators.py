"""The training-data operators against plain versions on small tables, with nulls, copies, long texts and clashing names."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bktree, decontaminate, eliasfano, fingerprints, html_text, langid, line_dedup, ngram_lm, packing, queries, sharding, simhash, url_filter

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("cls", T.StringType()), T.StructField("key", T.LongType())])
rng = np.random.default_rng(5)
VOCABULARY = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    words = list(r.choice(VOCABULARY, n))
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."


TEXTS = [prose(60 + 7 * i, i) for i in range(24)] + [None, "", "  \n", "x", prose(60, 0), prose(6000, 99)]
TEXTS += [TEXTS[5].replace(VOCABULARY[3], "other"), "Ünï Straße " + prose(30, 7)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "aa" if i % 2 else "bb", "c", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "aa", "c", 1), (None, TEXTS[4], None, None, None)]
    return spark.createDataFrame(rows, DOC).repartition(3, "text")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def words(t):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def test_elias_fano():
    v = np.sort(rng.integers(0, 1 << 40, 3000)).astype(np.uint64)
    ef = eliasfano.EliasFano.of(v, 1 << 41)
    at = rng.integers(0, 3000, 500)
    assert (ef.values(at) == v[at]).all()
    targets = np.concatenate([v[at], rng.integers(0, 1 << 40, 500).astype(np.uint64)])
    index, equal = ef.successor(targets)
    assert (index == np.searchsorted(v, targets)).all() and (equal == np.isin(targets, v)).all()


def test_bk_forest():
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40)]))
    forest = bktree.Forest(prints, np.zeros(len(prints), int))
    a, b = forest.within(prints, np.zeros(len(prints), int), 3)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(len(prints)) for j in range(len(prints)) if bin(int(prints[i]) ^ int(prints[j])).count("1") <= 3}


def test_language_sample_is_of_whole_texts(spark):
    rows = [(i, f"alpha beta gamma {i} " * 3, "a", None, None) for i in range(300)] + [(900, "delta " * 5000, "a", None, None), (901, "omega " * 300, "b", None, None), (902, "omega " * 300, "b", None, None), (903, "12", "c", None, None)]
    model = langid.train(spark.createDataFrame(rows, DOC), dictionary_bytes=4096)
    assert model.languages == ("a", "b") and model.dictionaries[1] == ("omega " * 300).encode()  # equal texts are one
    assert b"delta" not in model.dictionaries[0] and 3000 < len(model.dictionaries[0]) <= 4096 + 96
    assert model.dictionaries[0].count(b"alpha") == model.dictionaries[0].count(b"gamma") == 3 * round(model.dictionaries[0].count(b"alpha") / 3)


def test_language_of_odd_rows(spark):
    """One rule at every length: the fewest bytes over blocks, as a plain loop over the dictionaries finds them."""
    import zstandard

    chance = random.Random(4)
    words = {g: ["".join(chance.choice(letters) for _ in range(chance.randrange(2, 7))) for _ in range(60)] for g, letters in (("x", "abcdefg"), ("y", "efghijk"), ("z", "mnopqrs"))}
    make = lambda g, n: " ".join(chance.choice(words[g]) for _ in range(n))
    model = langid.train(spark.createDataFrame([(i, make(g, 80), g, None, None) for i, g in enumerate("xyz" * 20)], DOC))
    asked = [make(chance.choice("xyz"), n) for n in (1, 2, 5, 20, 80, 90, 170, 180, 400, 9000)] + [None, "", "1 2 3", "é", "same", "same", "\n" * 9]
    df = spark.createDataFrame([(i, t, "x", "c", 1) for i, t in enumerate(asked)], DOC).withColumnRenamed("lang", "score").withColumnRenamed("cls", "rejected")
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    for i, t in enumerate(asked):
        if not t or not any(c.isalpha() for c in t):
            assert got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0
            continue
        data = langid.canonical(t)
        sizes = []
        for d in model.dictionaries:
            of = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=model.level, dict_data=of, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(coder.compress(data[k : k + model.block_bytes])) for k in range(0, len(data), model.block_bytes)))
        assert got[i]["lang_pred"] == model.languages[sizes.index(min(sizes))] and 0 <= got[i]["score"] <= 1
        assert got[i]["rejected"] == ((sorted(sizes)[1] - min(sizes)) / len(data) < model.min_margin)
    assert langid.keep_identified(df, model).columns == df.columns
    assert len({got[i]["lang_pred"] for i in (14, 15)}) == 1


def test_language(spark, docs, empty):
    rows = [(i, ("the cat and the dog " if i % 2 else "der Hund und die Katze ") * 3, "en" if i % 2 else "de", None, None) for i in range(30)]
    model = langid.train(spark.createDataFrame(rows, DOC))
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame([(1, "The dog and the cat", None, None, None), (2, "Die Katze und der Hund", None, None, None), (3, None, None, None, None), (4, "12 !", None, None, None)], DOC), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and got[3]["rejected"]
    assert langid.identify(docs, langid.train(empty)).where("lang_pred = 'und'").count() == docs.count()
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0


@pytest.mark.parametrize("bits", [128, 3])
def test_fingerprints(docs, empty, bits):
    got = [(r["doc_id"], r["fingerprint"]) for r in fingerprints.fingerprints(docs, bits=bits).collect()]
    by = {}
    for key, mark in got:
        by.setdefault(fingerprints.canonical(TEXTS[4 if key is None else key]), set()).add(mark)
    assert all(len(m) == 1 for m in by.values()) and len(set.union(*by.values())) == len(by)
    assert fingerprints.fingerprints(empty).count() == 0 and fingerprints.against_next(empty).count() == 0


def plain_canonical(t):
    """Upper and lower case, widths, ligatures and white space alike: an independent form of the same equality."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())).strip()


@pytest.mark.parametrize("bits", [128, 4])
def test_edited_texts(spark, bits):
    special = ["Stra\u00dfe \ufb01n", "STRASSE  fin", "\u2460 x", "1\tX", "same " * 9, "same " * 9, "SAME " * 9, "a", "", None, " "]
    texts = TEXTS + special
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprints.against_next(spark.createDataFrame(rows, DOC).repartition(5), bits=bits).collect()}
    assert len(got) == len(texts)
    by = {}
    for i, t in enumerate(texts):
        t, following = t or "", texts[i - 1] or ""
        k = len(t) // 3
        changed = t[: len(t) - k] + following[:k]
        own, other, after = map(plain_canonical, (t, changed, following))
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_next"] == float(own == after) and got[i]["near_edited"] == float(own == other)
        by.setdefault(own, set()).add(got[i]["fingerprint"])
        by.setdefault(other, set()).add(got[i]["edited_fingerprint"])
    assert all(len(marks) == 1 for marks in by.values()) and len(set.union(*by.values())) == len(by)
    assert any(r["near_edited"] == 1 and r["n_chars"] > 9 for r in got.values())


def test_edited_texts_of_odd_rows(spark):
    rows = [(None, "no id one"), (None, "no id two"), (4, "four four four"), (4, "four four four"), (9, None), (-3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "text as fingerprint", "'x' as t")
    got = fingerprints.against_next(df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert {r["near_next"] for r in got if r["doc_id"] == 4} == {0.0, 1.0}  # the copy, then the empty text of -3
    one = fingerprints.against_next(df.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == one[0]["near_edited"] == 1.0


@pytest.mark.parametrize("chunk,shard", [(1 << 21, 1 << 21), (100, 1 << 21), (500, 700)])
def test_language_model(docs, empty, chunk, shard):
    trained = F.col("doc_id") % 5 != 0
    got = ngram_lm.score(docs, trained, chunk_tokens=chunk, shard_tokens=shard).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert all(r["train"] == (None if r["doc_id"] is None else r["doc_id"] % 5 != 0) for r in got)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    count, pairs, context, types = Counter(), Counter(), Counter(), Counter()
    for key, t in rows:
        if key is not None and key % 5:
            line = ["\n", *words(t), "\t"]
            count.update(line[1:])
            pairs.update(zip(line, line[1:]))
            context.update(line[:-1])
    types.update(a for a, _ in pairs)
    n, v = sum(count.values()), len(count)

    def p1(w):
        return (count[w] + 0.1) / (n + 0.1 * (v + 1))

    def logs(t):
        line, base, score = ["\n", *words(t), "\t"], 0.0, 0.0
        for a, b in zip(line, line[1:]):
            back = 0.75 * types[a] / context[a] if context[a] else 1.0
            base += math.log10(p1(b))
            score += math.log10((max(pairs[a, b] - 0.75, 0) / context[a] if context[a] else 0) + back * p1(b))
        return base, score, len(line) - 1

    want = sorted((logs(t) for _, t in rows), key=lambda x: x[0])
    have = sorted(((r["base_score"], r["score"], r["n_tokens"]) for r in got), key=lambda x: x[0])
    assert len(have) == len(want) and all(r["train_tokens"] == n for r in got)
    for (b, s, k), (base, score, tokens) in zip(have, want):
        assert abs(b - base) < 1e-6 * tokens and abs(s - score) < 5e-4 * tokens and k == tokens
    assert ngram_lm.score(empty, trained).count() == 0


def test_urls(spark):
    urls = ["http://a.net/x", "https://Example.NET/en/1?q", "http://b.example.com/de/", "http://c.org/fr/1", "http://c.org/en/1", "http://notnet/x", "http://a.net", None, "no scheme", "http://www.casino-win.example.org/en/1", "http://x.net/en/y"]
    want = ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, None, None, "net/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0])]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert [by[i]["rule"] for i in range(len(urls))] == want
    assert [by[i]["verdict"] for i in (0, 1, 2, 3, 4, 9)] == ["block", "allow", "block", "allow", "allow", "block"]
    assert by[1]["host"] == "example.net" and by[8]["host"] == by[8]["path"] == "" and by[6]["path"] == ""


def test_urls_against_sql_with_odd_rows(spark):
    """The query's SQL, on line feeds, control characters, clashing names, ties and an empty table."""
    import duckdb

    urls = ["http://a\nb.net/x", "x\ny://a.net/\nq?z", "://", "http://net", "http://net/", "http://.net/", "http://anet/", "HTTP://SUB.EXAMPLE.COM/de/\t", "http://x.org\n/fr/", "a://b://c.net/", "http://ads.\nx/", "http://x/wp-login.php", "http://x/wp-login.phpx", "http://b-ads.example.net/en/", "", None, "http://a.net/x#y/en/", "http://example.net/enx"]
    chance = random.Random(3)
    urls += ["".join(chance.choice(["http", "://", ".", "net", "example", "com", "org", "/", "de", "fr", "en", "/", "?", "#", "\n", "ads", "cgi-bin", "Net", " "]) for _ in range(chance.randrange(14))) for _ in range(600)]
    rows = [(i, u, "block", "h", 1) for i, u in enumerate([*urls, *urls[:3]])]
    schema = "page_id long, url string, verdict string, host string, _no int"
    pages = spark.createDataFrame(rows, schema)
    got = sorted(tuple(map(str, (r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]))) for r in url_filter.judge(pages).collect())
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    duck.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows])
    want = sorted(tuple(map(str, r)) for r in duck.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE_SQL['op4_url_filter']})").fetchall())
    assert got == want
    by = {int(r[0]): r for r in got}
    assert by[0][3:] == ("net/", "block") and by[1][2] == "/\nq"
    assert url_filter.judge(spark.createDataFrame([], schema)).count() == 0
    twice = (url_filter.Rule("block", "b.c", "/aa"), url_filter.Rule("allow", "c", "/aaaa"), url_filter.Rule("allow", "b.c", "/a'\\\\"))
    tied = url_filter.judge(spark.createDataFrame([(1, "http://b.c/aaaa"), (2, "http://b.c/a'\\\\x")], "page_id long, url string"), twice, ())
    assert {r["page_id"]: r["rule"] for r in tied.collect()} == {1: "b.c/aa", 2: "b.c/a'\\\\"}


def test_simhash_links(docs, empty):
    got = simhash.near_fingerprints(docs).collect()
    prints = {}
    for key, t in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        w = words(t)
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[key] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    near = {k: {j for j in prints if bin(prints[k] ^ prints[j]).count("1") <= 3} for k in prints}
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        seen, todo = set(), [r["doc_id"]]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += near[k]
        assert r["component_id"] == min(k for k in seen if k is not None)
    assert simhash.near_fingerprints(empty).count() == 0


@pytest.mark.parametrize("equal", [1, 2, 3])
def test_fingerprint_links_by_any_number_of_blocks(spark, equal):
    chance = random.Random(equal)
    base = [chance.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    prints = {x ^ sum(1 << b for b in chance.sample(range(64), n)) for x in base for n in (0, 1, 2, 3, 4)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    links = simhash.link_fingerprints(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), equal=equal).collect()
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        assert bin(a ^ b).count("1") <= 3
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a in prints for b in prints if bin(a ^ b).count("1") <= 3)


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_near_duplicates(spark, empty, block_rows):
    base = prose(200, 1).split(" ")
    texts = [" ".join(base[:i] + [f"new{i}"] + base[i + 1 :]) for i in range(0, 180, 15)] + [prose(200, 2), " ".join(base), " ".join(base), None, None]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)] + [(12, texts[12], None, None, None)], DOC)
    kept = simhash.keep_one(df, block_rows=block_rows)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 12, 15]
    assert simhash.keep_one(empty).count() == 0


def test_near_duplicates_with_other_repeat_counts(spark):
    def text(seed, times):
        lines = [prose(9, 700 + 40 * seed + i) for i in range(20)]
        return " ".join(lines + lines[:1] * times)

    df = spark.createDataFrame([(2 * i + j, text(i, times), None, None, None) for i in range(6) for j, times in enumerate((2, 60))], DOC)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [0, 2, 4, 6, 8, 10]


def test_line_dedup(spark, empty):
    shared = "Order 17 of the weekly letter was sent to all our readers today"
    texts = [prose(90, i) + "\n" + shared.replace("17", str(i)) + "\nAll rights reserved." for i in range(6)] + [prose(90, 50), None, "", prose(90, 50)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(df).collect()}
    assert "weekly letter" in got[0] and not any("weekly letter" in got[i] for i in range(1, 6))
    assert got[6] == texts[6] == got[9] and got[7] is None and got[8] == ""
    assert got[0] == texts[0] and all(got[i] == prose(90, i) for i in range(1, 6))  # short lines recur like any other
    assert line_dedup.line_report(empty).count() == 0


def plain_line_dedup(texts):
    """What stays of texts {id: text}, by comparing every two units; without the rule for near copies."""
    mask = lambda unit: re.sub("[0-9]+", "#", unit)

    def units(text):
        for pos, line in enumerate(text.split("\n")):
            pieces = re.split(r" (?<=[.!?] )(?<=[^.!?]{40}[.!?] )", line) if len(line.encode()) > 240 else []
            for sub, unit in enumerate([line, *pieces]):
                if unit.strip(" "):
                    yield pos, sub, unit

    def alike(a, b):
        x, y = mask(a).split(" "), mask(b).split(" ")
        if len(x) != len(y) or len(x) < 12:
            return x == y
        edges = [3 + (len(x) - 3) * i // 5 for i in range(6)]
        return x[:3] == y[:3] and sum(x[i:j] == y[i:j] for i, j in zip(edges, edges[1:])) >= 3

    everything = {key: list(units(t)) for key, t in texts.items()}
    first = {t: min(k for k in texts if texts[k] == t) for t in texts.values()}  # exact copies count as one text
    out = {}
    for key, text in texts.items():
        others = [u for k, us in everything.items() if k < first[text] for u in us]
        lost = {(pos, sub): len(unit.encode()) for pos, sub, unit in everything[key] if any(alike(unit, v) if sub == s == 0 else sub and s and mask(unit) == mask(v) for _, s, v in others)}
        kept = []
        for pos, line in enumerate(text.split("\n")):
            if (pos, 0) in lost:
                continue
            if not any(p == pos for p, _ in lost):
                kept.append(line)
                continue
            pieces = re.split(r" (?<=[.!?] )(?<=[^.!?]{40}[.!?] )", line)
            gone, run = set(), []
            for sub in range(1, len(pieces) + 2):
                if (pos, sub) in lost:
                    run.append(sub)
                    continue
                if sum(lost[pos, s] for s in run) >= 80:
                    gone.update(run)
                run = []
            rest = " ".join(piece for i, piece in enumerate(pieces, 1) if i not in gone)
            kept += [rest] if rest or not gone else []
        out[key] = "\n".join(kept)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_every_pair(spark, seed):
    r = random.Random(seed)
    sentences = [" ".join(prose(r.choice([3, 8, 12, 20]), 900 + 50 * seed + i).split()) for i in range(25)]

    def changed(line):
        words = line.split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            words[r.randrange(len(words))] = r.choice(["other", "17", "4", "name"])
        return " ".join(words)

    def line():
        kind = r.random()
        if kind < 0.2:
            return r.choice(["", " ", "Yes.", "All rights reserved."])
        made = [r.choice(sentences) if r.random() < 0.5 else prose(r.randrange(4, 20), r.randrange(10**6)) for _ in range(1 if kind < 0.6 else r.randrange(4, 12))]
        return changed(" ".join(" ".join(made).split()))

    texts = {i: "\n".join([line() for _ in range(r.randrange(1, 9))] + [prose(60, 10**7 + 100 * seed + i)]) for i in range(40)}
    texts |= {100: texts[7], 101: "", 102: sentences[3]}
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], DOC).repartition(3)
    want = plain_line_dedup(texts)
    settings = line_dedup.Settings(copy_share=2.0)  # no near copies
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(df, settings=settings).collect()} == want
    assert sum(a != texts[k] for k, a in want.items()) > 15


def test_line_dedup_of_passages_in_longer_lines(spark):
    passage = " ".join(prose(63, 610).split())
    texts = [f"{prose(40, 620)} {passage} {prose(30, 621)}\nown line one", f"own line two\n{prose(25, 622)} {passage} {prose(50, 623)}", passage.replace(". ", ".\n")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: r for r in line_dedup.line_report(df).collect()}
    assert got[0]["text"] == texts[0] and got[1]["n_cut"] >= 5 and got[1]["n_dropped"] == 0
    assert passage[80:-80] not in got[1]["text"] and got[1]["text"].startswith("own line two\n" + prose(25, 622)[:60]) and got[1]["text"].endswith(prose(50, 623)[-60:])


def test_line_dedup_of_odd_tables(spark):
    long = "\n".join(f"line {i} of a very long text with its own number {i % 7}" for i in range(20000))
    rows = [(1, "same line here now\nown a", 5, "x"), (None, "same line here now\nown b", 6, None), (1, "same line here now\nown a", 5, "x"), (2, long, 7, "y"), (3, "own c\n" + long, 8, "z"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, pos string")  # names that the operator uses too
    got = sorted(((r["doc_id"] or 9, r["text"], r["gone"]) for r in line_dedup.drop_recurring(df).collect()), key=str)
    assert [g[1] for g in got if g[0] == 1] == [rows[0][1]] * 2 and (9, "own b", 6) in got and (4, None, None) in got
    assert line_dedup.drop_recurring(df).columns == df.columns
    assert {g[0]: len(g[1] or "") for g in got}[3] in (5, len(rows[4][1]))  # all but its own line, or, as a near copy, nothing


def test_line_dedup_of_large_shares(spark):
    boiler = " ".join(prose(60, 300).split())
    page = [prose(20, 310 + i) + "\n" + boiler for i in range(3)]  # three quarters of a page recur: no near copies
    lines = [prose(30, 320 + i) for i in range(12)]
    near = ["\n".join(lines), "\n".join(lines[:11] + [prose(9, 340)])]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(page + near)], DOC)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(df).collect()}
    assert got == {0: page[0], 1: prose(20, 311), 2: prose(20, 312), 3: near[0], 4: near[1]}


def test_line_dedup_of_runs_of_short_lines(spark):
    run = [" ".join(prose(4 + i % 4, 500 + i).split()) for i in range(12)] + ["Yes.", "", "The end."]
    texts = ["\n".join([prose(120, 520 + i), *run, prose(120, 530 + i)]) for i in range(2)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(df).collect()}
    assert got == {0: texts[0], 1: prose(120, 521) + "\n\n" + prose(120, 531)}


def test_html():
    page = "<html><head><title>t</title><style>p{}</style></head><body><h1>A &amp; b<p>one<p>two <b>bold</b>  x<ul><li>i<li>j<ol><li>k</ol></ul><table><tr><td>aa<td>b<tr><td>c<td>d</table><p hidden>no<script>var t='</p>';</script><div style='display: none'>no</div><pre> x\n  y</pre>1 < 2"
    assert html_text.visible_text(page) == "A & b\n\none\n\ntwo bold x\n\n- i\n- j\n  1. k\n\naa  b\nc   d\n\n x\n  y\n\n1 < 2"
    assert html_text.visible_text(None) == "" and html_text.visible_text("<div>" * 5000 + "deep") == "deep"


def plain_rendering(tree):
    """Text of a random tree (tag, shown, children) by another way: a flat list of words and breaks, folded at the end."""
    events = []

    def walk(node, shown):
        tag, style, children = node
        if style == "display:none":
            return
        shown = {"visibility:hidden": False, "visibility: visible": True}.get(style, shown)
        gap = {"div": 1, "p": 2, "h2": 2}.get(tag, 0)
        if gap:
            events.append(gap)
        for child in children:
            if isinstance(child, str):
                events.extend(child.split() if shown else [])
            else:
                walk(child, shown)
        if gap:
            events.append(gap)

    walk(tree, True)
    out, wait = "", 0
    for e in events:
        if isinstance(e, int):
            wait = max(wait, e)
        else:
            out += ("\n" * wait if wait else " ") + e if out else e
            wait = 0
    return out


def test_html_against_a_plain_rendering():
    chance = random.Random(11)

    def made(depth, inside_p):
        tag = chance.choice(["span", "b", "em"] + ([] if inside_p else ["div", "p", "h2"]))
        style = chance.choice([None] * 6 + ["display:none", "visibility:hidden", "visibility: visible"])
        children = [f" {chance.choice(VOCABULARY)} {chance.choice(VOCABULARY)} " if depth == 0 or chance.random() < 0.4 else made(depth - 1, inside_p or tag in ("p", "h2", "span", "b", "em")) for _ in range(chance.randrange(4))]
        return tag, style, children

    def html(node):
        if isinstance(node, str):
            return node
        tag, style, children = node
        return f"<{tag}{f' style=\"{style}\"' if style else ''}>{''.join(map(html, children))}</{tag}>"

    trees = [("div", None, [made(4, False) for _ in range(5)]) for _ in range(300)]
    for tree in trees:
        assert html_text.visible_text(html(tree)) == plain_rendering(tree)
    assert sum(bool(plain_rendering(t)) for t in trees) > 200


def test_html_pages(spark):
    wide = "<table>" + "<tr><td>" + "x" * 20000 + "<td>end</tr>" + "<tr><td>a<td>b</tr>" * 1000 + "</table>"
    spans = "<table>" + "<tr><td colspan=1000 rowspan=1000>a<td colspan=1000>b</tr>" * 300 + "</table>"
    pages = ["<div style='visibility:hidden'>no<p style='visibility:visible'>yes</p>no<ul><li>no</ul></div>tail", None, "", wide, spans, "<p>same", "<p>same", "<table><tr><td>aaaa<td>b<tr><td>c<td>d</table>", "<blockquote>" * 300 + "deep"]
    df = spark.createDataFrame([(i, "u", h, "t") for i, h in enumerate(pages)] + [(None, "u", "null id", "t")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[0] == "yes\n\ntail" and got[1] == got[2] == "" and got[5] == got[6] == "same" and got[None] == "null id"
    assert got[3].split("\n")[:2] == ["x" * 20000 + "  end", "a  b"] and len(got[3]) < 2 * len(wide) and len(got[4]) < 4 * len(spans)
    assert got[7] == "aaaa  b\nc     d" and got[8].endswith("deep")
    assert html_text.extract(df.where("false")).count() == 0


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    reference = Tokenizer.from_file(path)
    coder = packing.Encoder(path, 0)
    assert coder.ranked and coder.added == ["<|endoftext|>"]
    pieces = ["word", "it's", "'ll", "x1,y;", "3.14", "größe", "é", "漢字", "привет", "🙂", "<|endoftext|>", "\x1f", "\x00", "'", "a\u0301", "\u00ad"]
    spaces = [" ", "\n", "  ", "\n\n", " \n", "\n ", "\t", "\u00a0", "\u2028", "\r\n", "\n\n\n", "\n \n", "   ", ""]
    chance = random.Random(7)
    usual = ["".join(chance.choice(pieces) + chance.choice([" ", " ", "\n"]) for _ in range(chance.randrange(9))) for _ in range(300)]
    mixed = ["".join(chance.choice(spaces) + chance.choice(pieces + spaces) for _ in range(chance.randrange(9))) for _ in range(1500)]
    texts = [None, "", " ", "\n", "<|endoftext|>", "hello <|endoftext|> x", "a<|endoftext|>b", "wide " * 40 + "\t" + "word " * 40, "x" * 5000, *usual, *mixed]
    for plain in (False, True):
        for at in range(0, len(texts), 90):
            part = texts[at : at + 90]
            ids, counts = coder.encode(pa.array(part, pa.string()))
            want = [reference.encode(t or "", add_special_tokens=False).ids + [0] for t in part]
            assert counts.tolist() == [len(w) for w in want]
            assert ids.tolist() == [i for w in want for i in w]
        coder.ranked = None  # the path of tokenizers of other kinds


def test_packing(docs, empty):
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    reference = Tokenizer.from_file(path)
    settings = packing.Settings(block_tokens=2000)
    got = packing.pack(docs, path, settings, with_ids=True).collect()
    encode = lambda t: reference.encode(t or "", add_special_tokens=False).ids + [0]
    texts = {r["doc_id"]: encode(r["text"]) for r in docs.collect()}
    for r in got:
        ids = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert ids == r["ids"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(texts[r["doc_id"]])
    assert sum(r["length"] for r in got) == sum(len(encode(r["text"])) for r in docs.collect())
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 1024
    assert packing.pack(empty, path).count() == 0


def test_cuts_are_optimal():
    s = packing.Settings(size=16, least_short=4, extra=3, cut_inside=5)
    for seed in range(30):
        r = np.random.default_rng(seed)
        places = np.unique(np.concatenate([[0], np.cumsum(r.integers(1, 9, 12))])).tolist()
        penalties = r.integers(0, 6, len(places)).tolist()

        def price(chosen):
            total = 0
            for a, b in zip(chosen, chosen[1:]):
                n = b - a
                if n > s.size:
                    return math.inf
                total += penalties[places.index(b)] + (0 if n == s.size else s.extra if n in (4, 8) else s.size - n + s.extra)
            return total

        best = min(price([0, *[p for i, p in enumerate(places[1:-1]) if mask >> i & 1], places[-1]]) for mask in range(1 << (len(places) - 2)))
        assert price(packing.cuts(places, penalties, s)) == best


def test_decontamination(spark, empty):
    item = "A train leaves the station at 9 and travels 120 km before it meets the slow bus of Anna near the old river bridge"
    changed = item.replace("120", "75").replace("Anna", "Peter").replace("9", "4")
    uneven = "If 5 boys eat 5 apples in total then how many apples do 7 girls eat in the same time"
    bench = spark.createDataFrame([(1, item), (2, "short one here now"), (3, uneven), (4, None), (5, "")], "item_id long, text string")
    texts = [prose(40, 1) + " " + item + ". " + prose(40, 2), prose(40, 3) + " " + changed + " " + prose(20, 4), prose(80, 5), None, "", uneven.replace("5 boys", "6 boys").replace("5 apples", "8 apples")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)] + [(0, texts[0], None, None, None)], DOC)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_items(df, bench).collect()}
    assert got[0, 1]["contaminated"] and got[0, 1]["slots"] == 0
    assert got[1, 1]["contaminated"] and got[1, 1]["slots"] >= 2
    assert not got[5, 3]["consistent"] and (2, 1) not in got
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5]
    assert decontaminate.find_items(empty, bench).count() == 0 and decontaminate.drop_contaminated(df, bench.where("false")).count() == df.count()


def test_decontamination_in_another_case(spark, empty):
    item = "In the north of Kenya the herds of Mary Otieno and Peter Mwangi cross the wide river Tana near the town of Garissa in spring"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    renamed = item.replace("Mary Otieno", "Jane Kimani").replace("Garissa", "Hola")
    texts = [prose(20, i) + " " + t + ". " + prose(20, 9 + i) for i, t in enumerate([item.upper(), item.title(), item.lower(), item, renamed])] + [prose(60, 30)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: r for r in decontaminate.find_items(df, bench).collect()}
    assert set(got) == {*range(5)} and all(r["contaminated"] for r in got.values())
    assert [got[i]["coverage"] for i in range(4)] == [1.0] * 4


def test_decontamination_of_shifted_items(spark):
    item = "Every spring the old farmer near New York counts 1,200 sheep on the green hill and sells 3.5 tons of wool to a small shop in Boston before the cold rain comes back over the wide valley"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = item.replace("New York", "Denver").replace("1,200", "950").replace("3.5", "7").replace("in Boston", "in San Diego")
    split = item.split(" ")
    texts = [" ".join(split[:20] + ["also"] + split[20:]), " ".join(split[:20] + split[21:]), other]
    df = spark.createDataFrame([(i, prose(20, i) + " " + t + ". " + prose(20, 9 + i), None, None, None) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: r for r in decontaminate.find_items(df, bench).collect()}
    assert all(got[i]["contaminated"] for i in range(3)) and got[2]["coverage"] == 1.0


def test_decontamination_with_conflicting_slots(spark):
    item = "If 5 boys eat 5 apples in total then how many apples do 7 girls eat in the same time"
    long = item + " when nobody else is at home and every one of them eats as fast as all of the others do on a day like that"
    bench = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    texts = [item.replace("5 apples", "8 apples"), long.replace("5 boys", "6 boys").replace("5 apples", "8 apples"), "5 boys eat 5 apples in total then we left. " + prose(40, 8) + " " + long.replace("5 boys", "6 boys").replace("5 apples", "8 apples")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_items(df, bench).collect()}
    assert got[0, 1]["contaminated"] and got[0, 1]["coverage"] == 1.0 and got[0, 1]["slots"] == 1
    assert got[1, 2]["contaminated"] and got[2, 2]["contaminated"] and got[2, 2]["coverage"] == 1.0


def test_decontamination_by_very_short_items(spark):
    bench = spark.createDataFrame([(1, "Blue Whale"), (2, "12,000"), (3, "one two three four"), (4, "Yes!"), (5, " . ")], "item_id long, text string")
    texts = ["blue   whale.", "The blue whale swims", "12 000", "12 000 men", "yes", "He said yes to one two three four of them", "!", None, "Yes? No"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate([*texts, texts[0]])], DOC)
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_items(df, bench).where("contaminated").collect())
    assert got == [(0, 1), (2, 2), (4, 4), (5, 3), (9, 1)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()) == [1, 3, 6, 7, 8]


UNITS = decontaminate.UNITS.split()


def plain_forms(text):
    """The forms of a text as lists of words and of template words."""
    marked = "".join(c + "^" if c == " " and i and (text[i - 1].isalnum() or text[i - 1] in ",;:") and text[i + 1 : i + 2].isupper() and text[i + 2 : i + 3].isalpha() else c for i, c in enumerate(text))
    words = "".join(c if c.isalnum() or c == "^" else " " for c in marked).lower().split()

    def merged(words, joins):
        out = []
        for w in words:
            if out and joins(out[-1], w):
                out[-1] += "_" + w
            else:
                out.append(w)
        return out

    def template(words):
        out = [re.sub(r"[0-9]+(?:_[0-9]+)*", "#", "^" if "^" in w else w) for w in words]
        return ["~" if i and out[i - 1].endswith("#") and w in UNITS else w for i, w in enumerate(out)]

    words = merged(words, lambda a, b: a.replace("_", "").isdigit() and b.isdigit())
    plain = [w.replace("^", "") for w in words]
    if plain == words:
        return [(2, words, template(words))]
    named = merged(words, lambda a, b: a.startswith("^") and b.startswith("^"))
    return [(0, named, template(named)), (1, plain, template(plain))]


def plain_found(docs, items):
    """What find_items gives, by comparing every window with every window: (doc, item) -> its best rating."""
    best = {}
    for item, content in items.items():
        for bkind, braw, bcanon in plain_forms(content or ""):
            size = min(len(braw), 8)
            at = [i for i in range(len(braw) - size + 1) if sum(not re.search("[#^~]", w) for w in bcanon[i : i + size]) >= min(4, size)] if len(braw) >= 4 else []
            for doc, text in docs.items():
                groups = {}
                for kind, raw, canon in plain_forms(text or ""):
                    if kind + bkind == 1:
                        continue
                    for pos in range(len(raw) - size + 1):
                        for b in at:
                            if canon[pos : pos + size] == bcanon[b : b + size]:
                                pairs = [(b + i, braw[b + i], raw[pos + i]) for i in range(size) if re.search("[#^~]", bcanon[b + i])]
                                for stretch in ((pos - b) // 16, (pos - b) // 16 + 1):
                                    groups.setdefault((min(kind, bkind), stretch), []).append((b, pos - b, pairs))
                for hits in groups.values():
                    pairs = {p for *_, ps in hits for p in ps}
                    changed = {(b, d) for _, b, d in pairs if b != d}
                    clashing = {place for place, b, d in pairs if b != d and any(x == b and y != d for x, y in changed)}
                    consistent = len(clashing) <= 0.2 * len({place for place, *_ in pairs})
                    matched, same = len({b for b, *_ in hits}), len({b for b, _, ps in hits if all(x == y for _, x, y in ps)})
                    held = consistent and matched / len(at) >= 0.5 or same / len(at) >= 2 / 3
                    rating = (held, matched / len(at), consistent, -min(s for _, s, _ in hits), matched, len(at), len(changed))
                    best[doc, item] = max(best.get((doc, item), rating), rating)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_against_every_window(spark, seed):
    r = random.Random(seed)
    common = VOCABULARY[:25]
    slots = {"#": lambda: r.choice(["5", "1,250.5", "120", "7", "12 000"]), "^": lambda: r.choice(["Anna", "Mary Ann Smith", "New York", "Otto"]), "~": lambda: r.choice(["3 km", "9 kilometers", "2.5 mm", "40 percent"])}

    def pattern(n):
        return [r.choice(common) if r.random() < 0.75 else r.choice("#^~") for _ in range(n)]

    fill = lambda words: " ".join(slots[w]() if w in slots else w for w in words)
    patterns = {i: pattern(r.choice([4, 6, 9, 14, 25, 40])) for i in range(12)}
    items = {i: fill(p) + "." for i, p in patterns.items()} | {50: None, 51: ""}
    docs = {}
    for i in range(40):
        words = list(r.choice(list(patterns.values())))
        for _ in range(r.choice([0, 0, 1, 3])):
            words[r.randrange(len(words))] = r.choice(common)
        if r.random() < 0.3:
            words.insert(r.randrange(len(words)), "also")
        body = items[r.randrange(12)] if r.random() < 0.4 else fill(words)
        docs[i] = f"{prose(r.choice([0, 12, 30]), 4000 + i)} {r.choice([str, str.upper, str.title, str.lower])(body)}, {' '.join(r.choice(common) for _ in range(r.choice([0, 30])))}"
    docs |= {90: None, 91: "", 92: docs[3]}
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs.items()], DOC).withColumnRenamed("cls", "item_id").withColumnRenamed("lang", "words").repartition(3)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["contaminated"], x["coverage"], x["consistent"], x["matched"], x["windows"], x["slots"]) for x in decontaminate.find_items(df, bench).collect()}
    want = {k: (*v[:3], *v[4:]) for k, v in plain_found(docs, items).items()}
    assert got == want and sum(v[0] for v in want.values()) > 15 and not all(v[0] for v in want.values())


@pytest.mark.parametrize("change", [("120", "1,250.5"), ("Anna", "Mary Ann Smith"), ("km", "kilometers"), ("9", "eleven hundred and 9")])
def test_decontamination_of_a_reparameterised_item(spark, change):
    item = "A train leaves the station at 9 and travels 120 km before it meets the slow bus of Anna near the old river bridge"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(0, prose(30, 1) + " " + item.replace(*change) + ". " + prose(20, 2), None, None, None)], DOC)
    assert decontaminate.find_items(df, bench).first()["contaminated"]


def test_sharding(docs, empty):
    limit = 3000
    got = sharding.assign(docs, limit, step=3).collect()
    assert len(got) == docs.count()
    sums, rows = Counter(), Counter()
    for r in got:
        sums[r["shard"]] += r["bytes"]
        rows[r["shard"]] += 1
    names = sorted(sums)
    assert not any(b.startswith(a) for a in names for b in names if a != b)
    for r in got:
        assert r["shard_bytes"] == sums[r["shard"]] and r["shard_rows"] == rows[r["shard"]]
        assert r["oversized"] == (sums[r["shard"]] > limit) and (not r["oversized"] or rows[r["shard"]] == 1 or len(r["shard"]) == 128)
    for name in names:  # only buckets over the limit split
        parent = name[:-1]
        assert not name or sum(n for s, n in sums.items() if s.startswith(parent)) > limit
    assert sharding.assign(empty, limit).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = "the quick train leaves the station and travels far before it meets the slow bus near the old river bridge today"
    texts = [(i, prose(120, i), "en") for i in range(8)] + [(8, prose(120, 3), "en"), (9, prose(60, 77) + " " + item + " " + prose(60, 78), "en"), (10, "123", "en")]
    texts += [(20 + i, "der Hund und die Katze laufen heute durch den Garten und das Haus " * 3, "de") for i in range(2)]
    docs = spark.createDataFrame([(i, t, g, "s", len(t)) for i, t, g in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert kept == {*range(8), 20}


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Every stage on nulls, empty and very long texts, repeated rows, further columns and an empty table."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    words = {"en": VOCABULARY[:150], "de": VOCABULARY[200:350]}
    text = lambda g, n, seed: " ".join(random.Random(seed).choices(words[g], k=n)) + "."
    rows = [(i, text("en" if i % 2 else "de", 80, i), "en" if i % 2 else "de") for i in range(20)]
    rows += [(30, None, "en"), (31, "", "de"), (32, "42 !", None), (33, text("en", 9000, 5), None), (None, text("de", 70, 77), None), (3, rows[3][1], "en"), (3, rows[3][1], "en"), (40, rows[5][1] + " end", "en")]
    item = "how many big red trains leave the small town at night when the river is high and cold"
    rows.append((41, text("en", 60, 300) + " " + item.upper() + " " + text("en", 60, 301), "en"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, cls string, gone int"
    docs = spark.createDataFrame([(i, t, g, "s", len(t or ""), "x", 1) for i, t, g in rows], schema)
    for place, table in (("full", docs), ("none", docs.where("false"))):
        table.write.parquet(str(tmp_path / place / "documents.parquet"))
        spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / place / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, str(tmp_path / "full")))
        assert now.columns == docs.columns
        seen[name] = sorted(str(r["doc_id"]) for r in now.select("doc_id").collect())
    clean = {*map(str, range(20)), "33", "None"}
    assert set(seen["language"]) == clean | {"40", "41"} and seen["language"].count("3") == 3
    assert seen["lines"] == seen["language"]
    assert sorted(set(seen["near_duplicates"])) == sorted(clean | {"41"}) and len(seen["near_duplicates"]) == len(clean) + 1
    assert set(seen["benchmark_leaks"]) == clean
    encode = Tokenizer.from_file(queries.tokenizer_path()).encode
    want = {r["doc_id"]: len(encode(r["text"], add_special_tokens=False).ids) + 1 for r in now.collect()}
    pieces = corpus_pipeline.run(spark, str(tmp_path / "full")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r["doc_id"]: r["n"] for r in pieces} == {r["doc_id"]: r["m"] for r in pieces} == want
