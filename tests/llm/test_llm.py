"""The training-data operators on small fixtures: brute force, round trips and awkward inputs."""

import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import boilerplate, canonical, leakage, mixture, names, neardup, pii, split, splits, turns, wordhash

CHUNK = "chunk_id string, ticker string, speaker string, title string, section string, text string"
COMPANIES = [("ABCDE", "Wevenar Networks Corporation"), ("FGHIJ", "Tasuzor Energy Inc."), ("KLMNO", "Wevobat Energy Inc.")]


def words(n, seed=0, vocabulary=4000):
    r = random.Random(seed)
    return " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(3 + (r.randrange(vocabulary) % 5))) for _ in range(n))


def companies(spark):
    return spark.createDataFrame(COMPANIES, "ticker string, name string")


# 1


def greedy(strength, size, overlap, slack):
    n, at, out = len(strength), 0, []
    ends = [np.flatnonzero(strength >= k) + 1 for k in (2, 1)]
    while at < n:
        far = min(at + size, n)
        end = far
        if far < n:
            for e in ends:
                ok = e[(e >= at + max(1, int(size * (1 - slack)))) & (e <= far)]
                if len(ok):
                    end = int(ok[-1])
                    break
        out.append((at, end))
        if end >= n:
            break
        back = end - overlap
        opens = [int(o) for o in [0, *(np.flatnonzero(strength >= 2) + 1)] if back - overlap // 2 <= o <= back + overlap // 2]
        at = min(max(opens[-1] if opens else back, at + 1), max(end, at + 1))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_pointer_doubling_equals_the_greedy_walk(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 3000))
    strength = r.choice([0, 1, 2, 3], n, p=[0.9, 0.05, 0.04, 0.01]).astype(np.int8) if seed % 3 else np.zeros(n, np.int8)
    size, overlap = int(r.integers(20, 400)), int(r.integers(0, 10))
    first, end = split._cuts(strength, size, overlap, 0.4)
    assert list(zip(first.tolist(), end.tolist())) == greedy(strength, size, overlap, 0.4)


def test_pieces(spark):
    long = ". ".join(words(20, i) for i in range(60)) + "."
    rows = [("a", long, 1), ("a", long, 2), ("b", words(400), 1), ("c", None, 1), ("d", "", 1), ("e", "x " * 20_000, 1), (None, words(500), 1)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, piece_no int")  # piece_no clashes with a result column
    got = split.split_oversized(df).toPandas()
    assert set(got["chunk_id"].fillna("-")) == {"a", "e", "-"}
    a = got[got.chunk_id == "a"].sort_values("piece_no")
    assert list(a.piece_no) == list(range(1, len(a) + 1)) and set(a.n_pieces) == {len(a)}
    assert all(len(t.split()) <= 400 and t in long for t in got[got.chunk_id == "a"].text)
    assert a.first_word.iloc[0] == 1 and a.last_word.iloc[-1] == 1200
    assert all(25 <= e - s + 1 <= 75 for s, e in zip(a.first_word.iloc[1:], a.last_word))
    assert all(t.endswith(".") for t in a.text)
    assert split.split_oversized(df.limit(0)).count() == 0


# 2


@pytest.mark.parametrize(
    "a,b,same",
    [("Liz Ficynim", "Elizabeth Ficynim", True), ("Fowigar, Oscar", "OSCAR FOWIGAR, CFA", True), ("Lucía McGeker", "Dr. Lucia T. McGeker", True), ("Amara Tearper", "Amara Teraper", True), ("Ruth Cygowyn", "Thomas Cygowyn", False), ("Amara Kahox", "Amara Teraper", False)],
)
def test_name_assignment(a, b, same):
    assert (names.name_cost(names.person(a)[1], names.person(b)[1]) <= 1) == same


def test_deletion_neighbourhoods_meet_within_one_edit():
    r = random.Random(1)
    for _ in range(300):
        a = "".join(r.choice("abcd") for _ in range(r.randrange(4, 8)))
        b = list(a)
        k = r.randrange(len(b))
        if r.random() < 0.5:
            b[k] = r.choice("abcd")
        elif k + 1 < len(b):
            b[k], b[k + 1] = b[k + 1], b[k]
        b = "".join(b)
        assert names.edits(a, b) <= 1 and names.deletes(a) & names.deletes(b)


def test_variant_spellings(spark):
    rows = [(t, s) for t, s in [
        ("ABCDE", "Ruth Cygowyn"), ("nyse:abcde", "Cygowyn, Ruth"), ("ABCDE US", "R. Cygowyn"), ("ABDCE", "Tom Cygowyn"), ("Wevenar Ntwks", "Thomas Cygowyn"), ("ABCDE", "Cygowyn"), ("ABCDE", "Operator"), ("ABCDE", "OPERATOR."),
        ("ABCDE", "Unknown Speaker"), ("ABCDE", ""), ("ABCDE", None), (None, "Ruth Cygowyn"), ("FGHIJ", "Ruth Cygowyn"), ("Energy Inc.", "X Y"), ("ABCDE", "Speaker"), ("FGHIJ ", "ruth  cygowyn"),
    ]]
    df = spark.createDataFrame([*rows, *rows], "ticker string, speaker string").withColumn("entity", F.lit(1))
    got = {tuple(r) for r in names.variant_spellings(df, companies(spark)).collect()}
    speakers = {g[1:] for g in got if g[0] == "speaker"}
    assert speakers == {
        ("ABCDE", "Cygowyn, Ruth", "R. Cygowyn"), ("ABCDE", "Cygowyn, Ruth", "Ruth Cygowyn"), ("ABCDE", "R. Cygowyn", "Ruth Cygowyn"), ("ABCDE", "Thomas Cygowyn", "Tom Cygowyn"), ("ABCDE", "OPERATOR.", "Operator"), ("FGHIJ", "Ruth Cygowyn", "ruth  cygowyn"),
    }
    tickers = {x for g in got if g[0] == "ticker" and g[1] == "ABCDE" for x in g[2:]}
    assert tickers == {"ABCDE", "nyse:abcde", "ABCDE US", "ABDCE", "Wevenar Ntwks"} and not any("Energy Inc." in g for g in got)
    assert names.variant_spellings(df.limit(0), companies(spark)).count() == 0


def executed_plans(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {runs.apply(i).executionId(): runs.apply(i).physicalPlanDescription() for i in range(runs.size())}


def test_spellings_send_nothing_that_grows_to_the_driver(spark):
    """No step of it, as it ran, is a broadcast: staged files and sides before an explode look small to the planner, and the driver builds what is broadcast."""
    rows = [("ABCDE", "Ruth Cygowyn"), ("nyse:abcde", "Cygowyn, Ruth"), ("ABCDE US", "R. Cygowyn"), ("FGHIJ", "Tom Nagar"), ("FGHIJ ", "Thomas Nagar"), ("FGHIJ", "T. Sobel"), ("FGHIJ", "T. R. Sobel")]
    before = executed_plans(spark)
    got = names.variant_spellings(spark.createDataFrame(rows, "ticker string, speaker string"), companies(spark)).collect()
    assert {tuple(r) for r in got if r[0] == "speaker"} == {
        ("speaker", "ABCDE", "Cygowyn, Ruth", "R. Cygowyn"), ("speaker", "ABCDE", "Cygowyn, Ruth", "Ruth Cygowyn"), ("speaker", "ABCDE", "R. Cygowyn", "Ruth Cygowyn"),
        ("speaker", "FGHIJ", "Thomas Nagar", "Tom Nagar"), ("speaker", "FGHIJ", "T. R. Sobel", "T. Sobel"),
    }
    ran = [p for k, p in executed_plans(spark).items() if k not in before]
    assert any("SortMergeJoin" in p for p in ran) and not any("BroadcastExchange" in p for p in ran)


# 3


def test_turns(spark):
    text = "\n".join(
        ["Opening remarks here.", "(00:12) Ruth Cygowyn: uh, Hello [laughter] everyone.", "00:00:20.000 --> 00:00:21.000", "RUTH CYGOWYN - CFO: More from me me.", "Outlook:", "Good.", "Q - Thomas Cyowyn: [inaudible]", "<Operator> The next question is from Oscar Fowigar.", "Oscar Fowigar (Analyst)", "Thanks."]
    )
    plain = [(f"p{i}", None, f"Ruth Cygowyn: line {i}\n(00:1{i}) Oscar Fowigar: hi there\nQ - Thomas Cyowyn: yes\n<Operator> go\nOscar Fowigar (Analyst)\nfine") for i in range(4)]
    df = spark.createDataFrame([("a", " Q & A", text), ("b", "qa", None), ("c", None, ""), ("d", "prepared", "No labels: just text."), *plain], "chunk_id string, section string, text string").withColumn("words", F.lit(0))
    got = [tuple(r) for r in turns.speaker_turns(df).filter("chunk_id = 'a'").orderBy("turn_no").select("turn_no", "speaker", "section", "words").collect()]
    assert got[0][:3] == (1, "ruth cygowyn", "qa") and got[0][3].startswith("Hello everyone.") and "Outlook" in got[0][3]
    assert [g[1] for g in got] == ["ruth cygowyn", "operator", "oscar fowigar"] and got[2][3] == "Thanks."
    assert turns.speaker_turns(df).filter("chunk_id in ('b', 'c', 'd')").count() == 0
    assert turns.speaker_turns(df.limit(0)).count() == 0


# 4


def test_boilerplate_matches_brute_force(spark):
    legal, share = "© 2024 Wevenar Networks every copy needs consent.", "Share\tthis  page with your best colleagues 12 times."
    rows = []
    for i in range(7):
        body = words(70, i)
        lines = [legal.replace("2024", str(2000 + i)), share if i < 5 else "Something else in here with six words", body] if i % 2 else [body, legal.upper(), share]
        rows.append((f"c{i}", ["ABCDE", "$abcde", "ABCDE-US"][i % 3], ("\r\n" if i % 2 else "\n").join(lines)))
    rows += [rows[0], ("s", "ABCDE", legal), ("x", None, legal), ("y", "ABCDE", None), ("z", "ABCDE", "")]
    df = spark.createDataFrame(rows, "chunk_id string, ticker string, text string").withColumn("line", F.lit(0))
    blocks, gone = boilerplate.company_boilerplate(df, companies(spark))
    got = {(r["source"], r["line"]): r["support"] for r in blocks.collect()}
    assert got == {("ABCDE", "© # wevenar networks every copy needs consent."): 7, ("ABCDE", "share this page with your best colleagues # times."): 6}
    assert blocks.select("block").distinct().count() == 1
    clean = {r["chunk_id"]: r["text"] for r in boilerplate.without_lines(df.dropDuplicates(["chunk_id"]), gone, "chunk_id").collect()}
    assert clean["c0"].strip() == rows[0][2].split("\n")[0] and clean["y"] is None and clean["s"] == ""
    assert boilerplate.company_boilerplate(df.limit(0), companies(spark))[0].count() == 0


# 5


def test_differencing_balances():
    r = random.Random(0)
    w = [r.randrange(1, 100) for _ in range(400)]
    at = splits.difference([float(x) for x in w], 8)
    sums = [sum(x for x, b in zip(w, at) if b == k) for k in range(8)]
    assert max(sums) - min(sums) <= 2 and len(at) == 400
    assert splits.difference([], 3) == [] and sorted(splits.difference([5.0, 5.0], 2)) == [0, 1]


def test_grouped_splits(spark):
    r = random.Random(4)
    rows = [(f"T{min(99, int(r.expovariate(0.04))):02d}", f"q{i}", r.gauss(0, 1) if i % 9 else None if i % 2 else float("nan"), "keep") for i in range(1500)]
    rows += [("HOT", f"q{i}", 0.0, "keep") for i in range(700)] + [rows[0], (None, "q", 1.0, "keep"), ("", "q", 1.0, "keep"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "ticker string, quarter string, abnormal_ret_1d double, split string")  # split clashes
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15)], "split_name string, target_share double")
    out = splits.grouped_splits(df, ["ticker"], targets, "abnormal_ret_1d").toPandas()
    assert len(out) == len(rows) and out.split.notna().all()
    assert out.dropna(subset=["ticker"])[lambda x: x.ticker != ""].groupby("ticker").split.nunique().max() == 1
    share = out.split.value_counts() / len(out)
    assert abs(share["train"] - 0.7) < 0.02 and abs(share["test"] - 0.15) < 0.02
    assert splits.grouped_splits(df.limit(0), ["ticker"], targets).count() == 0


def test_levels_of_bins(spark):
    parts = spark.range(500).select(F.col("id").cast("string").alias("part"), (F.col("id") % 17 + 1).cast("double").alias("weight"))
    sums = splits.balanced_bins(parts, 6, group=60).join(parts, "part").groupBy("bin").agg(F.sum("weight").alias("w")).toPandas().w
    assert len(sums) == 6 and sums.max() - sums.min() < 10


def test_linked_keys_share_a_split(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "z")], "k string, l string")
    t = spark.createDataFrame([("p", 0.5), ("q", 0.5)], "split_name string, target_share double")
    out = {(r["k"], r["l"]): r["split"] for r in splits.grouped_splits(df, ["k", "l"], t).collect()}
    assert out["a", "x"] == out["b", "x"] == out["b", "y"]


# 6


def jaccard_pairs(rows, threshold, shingle, least):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if i is not None and len(w) >= least:
            sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_near_duplicates_match_brute_force(spark):
    r, rows = random.Random(5), []
    for i in range(40):
        base = words(120, i, 60).split(" ")
        rows.append((f"d{i:03d}", " ".join(base)))
        for k in range(3):
            new = list(base)
            for _ in range(r.randrange(0, 12)):
                new[r.randrange(len(new))] = "Ünïque"
            rows.append((f"d{i:03d}v{k}", " ".join(new)))
    rows += [("copy", rows[0][1].upper() + " !"), ("short", "too few words"), ("n", None), ("e", ""), (None, rows[0][1]), rows[3], ("long", words(60_000, 9)), ("same", "a " * 100)]
    df = spark.createDataFrame(rows, "chunk_id string, text string").withColumn("class", F.lit("clash"))
    members, pairs = neardup.near_duplicates(df)
    want = jaccard_pairs(rows, 0.7, 3, 60)
    assert {tuple(x) for x in neardup.duplicate_pairs(members, pairs).collect()} == want and len(want) > 50
    links = {}
    for a, b in want:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    assert {x["id"]: x["links"] for x in neardup.duplicate_groups(members, pairs).collect()} == links
    assert neardup.duplicate_pairs(*neardup.near_duplicates(df.limit(0))).count() == 0


def test_word_hashes_agree_with_words():
    table = wordhash.alnum_table()
    texts = ["Hello, hello  WORLD", "", "日本 don't 9.5 ½", "hello"]
    h, first = wordhash.word_hashes(texts, table)
    flat = [w for t in texts for w in re.findall(r"[^\W_]+", t.lower())]
    assert len(h) == len(flat) and list(np.diff(first)) == [len(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


# 7


def test_canonical_titles(spark):
    ref = [(1, "Chief Executive Officer"), (2, "President and Chief Executive Officer"), (3, "Vice President of Finance"), (4, "Senior Vice President of Finance"), (5, "Equity Analyst"), (6, None)]
    typed = {"C.E.O.": 1, "Pres. & CEO": 2, "Finance, VP": 3, "Sr. V.P. Finanec": 4, "Hexley Research - Eq. Analyst": 5, "equity analyst (Foo & Co.)": 5, "Archivist": 0, "-": 0, " ": 0, "Chief Whatever": 0, "x" * 30_000: 0}
    df = spark.createDataFrame([(t,) for t in [*typed, *typed, None, ""]], "title string").withColumn("ref_id", F.lit("clash"))
    got = {r["value"]: r["ref_id"] for r in canonical.match_canonical(df, spark.createDataFrame(ref, "title_id int, title string")).collect()}
    assert got == typed
    assert canonical.match_canonical(df.limit(0), spark.createDataFrame(ref, "title_id int, title string")).count() == 0
    assert {r["ref_id"] for r in canonical.match_canonical(df, spark.createDataFrame([], "title_id int, title string")).collect()} == {0}


def test_prefix_join_keeps_every_pair_above_the_threshold(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice(string.ascii_lowercase) for _ in range(9)) for _ in range(25)]
    entry = [(i, " ".join(r.sample(vocabulary, r.randrange(3, 8)))) for i in range(1, 25)]
    typed = [" ".join(r.sample(t.split(), len(t.split()) - (len(t.split()) > 4))) for _, t in entry]
    got = {x["value"]: x["similarity"] for x in canonical.match_canonical(spark.createDataFrame([(t,) for t in typed], "title string"), spark.createDataFrame(entry, "title_id int, title string"), threshold=0.6).collect()}
    for t in typed:
        best = max(len(set(t.split()) & set(e.split())) / len(set(t.split()) | set(e.split())) for _, e in entry)
        assert got[t] == pytest.approx(best) if best >= 0.6 else got[t] is None


# 8


def test_leaks_match_brute_force(spark):
    r = random.Random(6)
    items = [(i, words(r.randrange(8, 60), i)) for i in range(25)] + [(98, None), (99, "")]
    docs = []
    for d in range(60):
        t = words(80, 1000 + d).split(" ")
        if d % 2:
            w = items[r.randrange(25)][1].split(" ")
            k = r.randrange(max(1, len(w) - 14))
            t[20:20] = [x.upper() + "," for x in w[k : k + r.randrange(9, 16)]]
        docs.append((d, "  ".join(t)))
    docs.append((70, "start of it " + " ".join(items[20][1].split(" ")[:12]) + "."))  # ends in a mark where the item goes on
    docs += [(1000, None), (1001, ""), (1002, words(60_000, 3) + " " + items[20][1]), (None, items[20][1]), docs[1]]
    want = set()
    for d, t in docs:
        dw = re.findall(r"[^\W_]+", (t or "").lower())
        grams = {tuple(dw[k : k + 12]) for k in range(len(dw) - 11)}
        for i, x in items:
            iw = re.findall(r"[^\W_]+", (x or "").lower())
            if d is not None and any(tuple(iw[k : k + 12]) in grams for k in range(len(iw) - 11)):
                want.add((d, i))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id long, text string")
    for edits, item_bytes in ((1, leakage.ITEM_BYTES), (0, leakage.ITEM_BYTES), (0, 0), (1, 0)):  # sent to all tasks, and joined on q-grams
        got = leakage.leaked_items(df, it, edits=edits, item_bytes=item_bytes)
        assert {(x["doc_id"], x["item_id"]) for x in got.filter("run_words >= 12").collect()} == want and len(want) > 8
    one, two = (sorted(map(tuple, leakage.leaked_items(df, it, item_bytes=n).collect())) for n in (leakage.ITEM_BYTES, 0))
    assert one == two
    assert leakage.leaked_items(df.limit(0), it).count() == 0 and leakage.leaked_items(df, it.limit(0)).count() == 0


def test_one_edit_is_tolerated_and_two_are_not(spark):
    item = words(12, 77)
    near, far = list(item), list(item)
    near[30] = "#" if near[30] == " " else {"a": "b"}.get(near[30], "a")
    far[20], far[40] = "zz", "yy"
    df = spark.createDataFrame([(1, f"pre {''.join(near)} post"), (2, f"pre {''.join(far)} post"), (3, item)], "doc_id long, text string")
    got = {r["doc_id"]: r["edits"] for r in leakage.leaked_items(df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert got.get(3) == 0 and got.get(1) == 1 and 2 not in got


# 9


def test_raking_meets_sources_and_caps():
    r = np.random.default_rng(0)
    tokens = r.integers(0, 1000, (4, 3, 2)).astype(float)
    tokens[3] = 0
    shares, caps = np.array([0.4, 0.3, 0.2, 0.1]), np.array([1.0, 2.0, 4.0, 4.0])
    w = mixture.rake(tokens, shares, caps)
    used = (w * tokens).sum((1, 2))
    assert np.allclose(used[:3] / used.sum(), shares[:3] / 0.9, atol=1e-6) and used[3] == 0
    assert (w <= caps[:, None, None] + 1e-9).all() and (w >= 0).all()


def test_mixture(spark):
    docs = [(i, ["big", "small", "other", None][0 if i % 10 < 7 else 1 if i % 10 < 8 else 2 if i % 10 < 9 else 3], words(20 + i % 30, i), ["en", "de", None, "xx"][i % 4], "Results" if i % 3 else None) for i in range(900)]
    docs += [(5000, "big", None, "en", None), (5001, "big", "", "en", None), (None, "big", "text", "en", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, lang string, title string").withColumn("n_tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    records, shares = mixture.mix_sources(df, targets, per_bucket=200)
    rec, sh = records.toPandas(), shares.toPandas().set_index("source")
    assert abs(sh.reached_share["big"] - 2 / 3) < 0.02 and abs(sh.reached_share["small"] - 1 / 3) < 0.02 and sh.reached_share["absent"] == 0
    assert rec.doc_id.is_unique and rec[rec.source == "small"].repeats.max() <= 4 and rec[rec.source == "big"].repeats.max() == 1
    assert set(rec.source) == {"big", "small"} and not {5000, 5001} & set(rec.doc_id)
    empty_records, empty_shares = mixture.mix_sources(df.limit(0), targets)
    assert empty_records.count() == 0 and empty_shares.count() == 3


def test_tokens_decode_to_the_text(spark):
    import base64

    import tiktoken

    text = "naïve 日本 <|endoftext|>  two  spaces\n1234"
    with open(f"{mixture.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    code = tiktoken.Encoding("t", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s""", mergeable_ranks=ranks, special_tokens={})
    assert code.decode(code.encode_ordinary(text)) == text
    got = mixture.token_counts(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")).collect()
    assert {r["id"]: r["n_tokens"] for r in got} == {1: len(code.encode_ordinary(text)), 2: 0, 3: 0}


# 10


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ruth Batek can be reached at ruth.batek@example.com or (212) 555-0178.", [("name", "Ruth Batek"), ("email", "ruth.batek@example.com"), ("phone", "(212) 555-0178")]),
        ("Anand Oz can be reached at oz.anand at ir dot example dot com or x", [("name", "Anand Oz"), ("email", "oz.anand at ir dot example dot com")]),
        ("ping me: leila.x (at) corp.example now", [("email", "leila.x (at) corp.example")]),
        ("mail rуan@ex​ample.org today", [("email", "rуan@ex​ample.org")]),
        ("call five five five zero one two three four five six, ok", []),
        ("dial (two one two) no", []),
        ("You can call 1-720-555-0138 ext. 478 after", [("phone", "1-720-555-0138 ext. 478")]),
        ("tel +44 20 7946 0101 65 of our 18 largest", [("phone", "+44 20 7946 0101")]),
        ("Send it to Olga Lusek, Flat 26, 168 Clocktower Lane, Yosek Valley.", [("name", "Olga Lusek"), ("address", "Flat 26, 168 Clocktower Lane, Yosek Valley")]),
        ("Lives at P.O. Box 4062, Laven Creek, according to the register", [("address", "P.O. Box 4062, Laven Creek")]),
        ("to 44 Clocktower Ave., Gacalford, OH 00711.", [("address", "44 Clocktower Ave., Gacalford, OH 00711")]),
        ("The form lists SSN 919-26-4510; passport no. X9121502 was used to register", [("id_number", "919-26-4510"), ("id_number", "X9121502")]),
        ("Die Ausweisnummer lautet QQ 15 40 63 C, ausgestellt für C. Mutezel.", [("id_number", "QQ 15 40 63 C"), ("name", "C. Mutezel")]),
        ("The witness was Dr. Richard B. Wiyason, who left", [("name", "Richard B. Wiyason")]),
        ("Demand for Simon Link rose. According to the minutes, Order 44148-40-012 shipped 2027-12-15.", []),
        ("CUSIP 009911XZ10, INC-5938-27, Handle @call_recaps posted", []),
        ("", []),
    ],
)
def test_details(text, want):
    got = [(k, text[b:e]) for b, e, k in pii.details(text)]
    assert got == want


def test_offsets_survive_deobfuscation():
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice(["a", " at ", "[dot]", "​", "е", "one two three four five ", "x", ".", " "]) for _ in range(30))
        norm, b, e = pii.deobfuscate(text)
        assert b is None and norm == text or (len(norm) == len(b) == len(e) and all(0 <= x < y <= len(text) for x, y in zip(b, e)) and b == sorted(b))


def test_spelled_digits_map_back():
    text = "call two one two five five five zero one seven eight now"
    norm, b, e = pii.deobfuscate(text)
    at = norm.index("2125550178")
    assert text[b[at] : e[at + 9]].strip() == "two one two five five five zero one seven eight"


def test_find_and_redact(spark):
    rows = [(1, "signed Ruth Batek\nSend to a@b.example"), (2, None), (3, ""), (None, "a@b.example"), (1, "x@y.example"), (4, "word " * 200_000 + "a@b.example")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    got = sorted((str(r["doc_id"]), r["kind"], r["value"]) for r in pii.find_details(df).collect())
    assert got == [("1", "email", "a@b.example"), ("1", "email", "x@y.example"), ("1", "name", "Ruth Batek"), ("4", "email", "a@b.example"), ("None", "email", "a@b.example")]
    red = [(r["doc_id"], r["text"]) for r in pii.redact(df).collect()]
    assert (1, "signed [NAME]\nSend to [EMAIL]") in red and (2, None) in red and (3, "") in red
    assert pii.find_details(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_turns_of_names_in_no_list(spark):
    """Speakers nobody listed, in layouts mined from the texts alone (no speaker column): at least 0.9 of the turns, and as few false ones."""
    first = "Bogdan Thandiwe Sundar Satya Ngozi Lakshmi Siobhan Zbigniew Oluwaseun Xiulan Bronagh Tuğba".split()
    last = "Petrescu Mokoena Pichai Nadella Okafor Narayanan Walsh Wójcik Adeyemi Nguyễn Gallagher Yıldız".split()
    r = random.Random(5)
    people = [f"{a} {b}" for a in first for b in last]
    layouts = ["{}: ", "[00:{:02d}:10] {}: ", "{} -- Analyst\n", ">> {}: ", "Q - {}: ", "{} (Executive)\n"]
    rows, want = [], set()
    for i in range(150):
        lines, said = [], []
        for k in range(4):
            who, form = r.choice(people), layouts[i % len(layouts)]
            said.append(who)
            lines.append((form.format(k, who) if form.count("{") > 1 else form.format(who)) + f"we saw steady demand in region {k} and costs fell.")
            if k == 1:
                lines.append(r.choice(["Segment Results:", "Balance Sheet:", "Key Points:"]))
                lines.append("the balance sheet and segment results have key points to note.")
        rows.append((f"c{i}", None, "qa", "\n".join(lines)))
        merged = [w for j, w in enumerate(said) if not j or said[j - 1] != w]
        want |= {(f"c{i}", n, w.lower()) for n, w in enumerate(merged, 1)}
    df = spark.createDataFrame(rows, "chunk_id string, speaker string, section string, text string")
    for column in ("speaker", None):
        got = {(x["chunk_id"], x["turn_no"], x["speaker"]) for x in turns.speaker_turns(df, speaker_col=column).collect()}
        assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got), (len(got), len(want), len(got & want))


def test_long_labels_are_labels():
    """A label of more than 14 tokens is one."""
    line = "Ruth Cygowyn, Vice President, Head of Finance, Treasury, Planning, Risk, and Investor Relations of Europe: Hello."
    layout, spans, begin = turns.head(line)
    assert line[slice(*spans[0])] == "Ruth Cygowyn" and line[begin:].strip() == "Hello." and "…" in layout


def test_details_of_names_in_no_list(spark):
    """Names outside any list, in contexts the corpus teaches: at least 0.9 found, and as few false ones."""
    r = random.Random(2)
    first = "Bogdan Thandiwe Sundar Satya Ngozi Lakshmi Siobhan Zbigniew Oluwaseun Xiulan Bronagh Dagny".split()
    last = "Petrescu Mokoena Pichai Nadella Okafor Narayanan Walsh Wojcik Adeyemi Nguyen Gallagher Yildiz".split()
    known = "Helen Thomas Maria Oscar Claire Simon".split()
    forms = ["The parcel was collected by {} before noon.", "{} moved to the second floor.", "Keys are with {} until Friday.", "Please call {} on Monday.", "Dr. {} examined the patient.", "The claim, says {}, was late."]
    noise = ["The plant near {} Junction is ahead of schedule.", "The {} Link rollout is small.", "We sold {} Flow in Iberia.", "{} Edge pricing went up 5 percent."]
    docs, want = [], set()
    for i in range(240):
        new = i % 5 < 2
        name = f"{r.choice(first if new else known)} {r.choice(last)}"
        lines = [r.choice(forms).format(name), r.choice(noise).format("".join(r.choice(string.ascii_lowercase) for _ in range(6)).title()), "Costs fell by 3.4 percent."]
        r.shuffle(lines)
        docs.append((i, " ".join(lines) if i % 2 else "\n".join(lines)))
        if new:
            want.add((i, name))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(x["doc_id"], x["value"]) for x in pii.find_details(df).filter("kind = 'name'").collect()}
    fresh = {f for f in found if f[1].split()[0] not in known}
    assert len(fresh & want) >= 0.9 * len(want) and len(fresh & want) >= 0.9 * len(fresh), (len(want), len(fresh), len(fresh & want), sorted(fresh - want)[:9])


@pytest.mark.parametrize(
    "text,kind,value",
    [
        ("Please call Satya Nadella on Monday", "name", "Satya Nadella"), ("Dr. Thandiwe Mokoena examined the patient", "name", "Thandiwe Mokoena"), ("Sede: Via Roma 12, 00184 Roma, primo piano", "address", "Via Roma 12, 00184 Roma"),
        ("Besuch: Hauptstr. 5, 10115 Berlin bitte", "address", "Hauptstr. 5, 10115 Berlin"), ("Tokyo +81-3-1234-5678 office", "phone", "+81-3-1234-5678"),
        ("mail " + "a" * 60 + "." + "b" * 60 + "@example.org now", "email", "a" * 60 + "." + "b" * 60 + "@example.org"),
    ],
)
def test_details_of_many_forms(text, kind, value):
    assert [(k, text[b:e]) for b, e, k in pii.details(text)] == [(kind, value)]


def test_long_names_are_linked(spark):
    """Names of six and more words a letter apart, a company of nine words, and two edits in a long word."""
    six = "Maria Teresa Consuelo Fernanda Castellanos Villarreal"
    assert names.name_cost(six.lower().split(), six.lower().replace("castellanos", "castelanos").split()[::-1]) == 1
    assert names.name_cost(six.lower().split(), six.lower().replace("castellanos", "castelanos").replace("fernanda", "fernandu").split()) == 2
    firm = "International Consolidated Mining Smelting Refining Shipping Trading Holdings Wevenar"
    rows = [("ABCDE", six), ("ABCDE", six.replace("Castellanos", "Castelanos").upper()), (firm, "Ruth Cygowynstein-Mapolara"), (f"{firm} Inc".replace(" Inc", ""), "Ruth Cygowinstein-Mapolaro"), ("ABCDE", "Ruth Sobel"), ("ABCDE", "Ruth Nagar")]
    df = spark.createDataFrame(rows, "ticker string, speaker string")
    got = {tuple(r) for r in names.variant_spellings(df, spark.createDataFrame([("ABCDE", firm)], "ticker string, name string")).collect()}
    assert {g[2:] for g in got if g[0] == "ticker"} == {("ABCDE", firm)}
    assert {g[2:] for g in got if g[0] == "speaker"} == {tuple(sorted((six, rows[1][1]))), tuple(sorted((rows[2][1], rows[3][1])))}


def test_assignment_equals_brute_force():
    from itertools import permutations

    r = random.Random(1)
    for _ in range(200):
        n, m = r.randrange(1, 5), r.randrange(4, 6)
        cost = [[r.choice([0, 0.25, 1, 2, float("inf")]) for _ in range(m)] for _ in range(n)]
        assert names.assign(cost) == min(sum(cost[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))
    assert names.assign([]) == 0


def test_groups_report_what_means_nothing(spark):
    df = spark.createDataFrame([("ABCDE", "Ruth Cygowyn"), ("whatever", "Ruth Cygowyn"), (None, None), ("", "Tom Nagar"), ("abcde", "unknown")], "ticker string, speaker string")
    got = {tuple(r) for r in names.spelling_groups(df, companies(spark)).select("field", "ticker", "spelling").collect()}
    assert got == {("ticker", "ABCDE", "ABCDE"), ("ticker", "ABCDE", "abcde"), ("ticker", None, "whatever"), ("speaker", "ABCDE", "Ruth Cygowyn")}


@pytest.mark.parametrize("block", [2, 7, 10_000])
def test_collisions_match_brute_force_however_values_are_cut(spark, block):
    """One value shared by a third of all classes, cut into blocks: the pairs are those that agree in enough coordinates."""
    r = random.Random(block)
    rows = [(i, [7 if k == 0 and i % 3 == 0 else 1000 * k + r.randrange(5) for k in range(7)]) for i in range(60)] + [(100, [1, 2, 3])]
    df = spark.createDataFrame(rows, "class bigint, signature array<bigint>")
    want = {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) >= neardup.MATCHES}
    got = [tuple(x) for x in neardup._collisions(df, block).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20


def test_margins_are_met_where_caps_allow():
    """Sources, languages and topics all meet their shares if no cap binds; with tight caps the sources still do."""
    r = np.random.default_rng(1)
    tokens, shares = r.uniform(500, 1500, (4, 3, 2)), np.array([0.4, 0.3, 0.2, 0.1])
    w = mixture.rake(tokens, shares, np.full(4, 50.0))
    got = w * tokens
    assert np.allclose(got.sum((1, 2)) / got.sum(), shares, atol=1e-6)
    for axes in ((0, 2), (0, 1)):
        assert np.allclose(got.sum(axes) / got.sum(), tokens.sum(axes) / tokens.sum(), atol=1e-4)
    tight = mixture.rake(tokens, shares, np.array([1.0, 3.0, 3.0, 3.0])) * tokens
    assert np.allclose(tight.sum((1, 2)) / tight.sum(), shares, atol=1e-6)


def test_topics_of_ones_own(spark):
    docs = spark.createDataFrame([(i, "word " * (20 + i % 7), "ab"[i % 2], "en", "t", "xyz"[i % 3]) for i in range(300)], "doc_id long, text string, source string, lang string, title string, topic string")
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 3)], "source string, target_share double, max_repeats int")
    records, shares = mixture.mix_sources(docs, targets, topic_col="topic")
    assert {x["topic"] for x in records.select("topic").distinct().collect()} == set("xyz")
    assert all(abs(x["reached_share"] - x["target_share"]) < 0.02 for x in shares.collect())
    for m in mixture.mix_margins(mixture.mixture_cells(docs, targets, topic_col="topic"), records, shares).collect():
        assert abs(m["wanted"] - m["reached"]) < 0.03


def test_levels_balance_as_well_as_one(spark):
    """Bins of a level-wise balance and of a single one differ by less than a hundredth of a bin."""
    parts = spark.range(3000).select(F.col("id").cast("string").alias("part"), (F.pmod(F.xxhash64("id"), F.lit(97)) + 1).cast("double").alias("weight"))
    spread = {}
    for group in (500, 4000):
        sums = splits.balanced_bins(parts, 20, group=group).join(parts, "part").groupBy("bin").agg(F.sum("weight").alias("w")).toPandas().w
        spread[group] = (sums.max() - sums.min()) / sums.mean()
    assert max(spread.values()) < 0.01, spread
