"""Training-data operators and the pipeline against plain Python, and the defined results of repeated ids, few labels, hot groups and odd rows."""

import base64
import hashlib
import itertools
import math
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslink.llm import ann, bpe, chat, language_id, mixing, near_dup, quality_rules, secret_scan, sharding, toxicity
from corpuslink.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPLIT.split(text or "") if w]


# ---- near duplicates ----


def components_of(rows, size, percent=80):
    """Index to the least (id is null, id) of its component, by comparing all pairs of sets; None without shingles."""
    sets = []
    for _, t in rows:
        w = words((t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
        n = min(size, len(w)) if w else 0
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (True, 0)), (k is None, k or 0))
    return [least[root(i)] if sets[i] else None for i in range(len(rows))], sets


def test_one_id_with_several_texts_keeps_all_links(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, a), (5, b), (6, a + " z"), (7, b + " z"), (5, a), (None, "lonely words here"), (None, b + " y"), (8, None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == Counter([(5, 5, True)] * 3 + [(6, 5, False), (7, 5, False), (None, None, True), (None, 5, False), (8, 8, True)])
    kept = near_dup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter({5: 2, None: 1, 8: 1})


def test_ids_of_any_type_and_clashing_names(spark):
    text = " ".join(f"a{i}" for i in range(40))
    df = spark.createDataFrame([("x", text, 1, 2), ("b", text + " z", 3, 4)], "doc_id string, text string, t int, h int")
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df).collect()} == {"x": "b", "b": "b"}
    assert near_dup.deduplicated(df).collect() == [("b", text + " z", 3, 4)]


def test_recall_where_a_crowd_is_almost_as_near(spark):
    """Texts of one boilerplate, nearer to one partner than the threshold, farther from all others: every pair must come out."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows, want = [], {}
    for p in range(250):
        shared = rng.choice(300, 9, replace=False)
        for side in (0, 1):
            own = [f"s{p}_{i}" if i in shared else w for i, w in enumerate(base)]
            for i in rng.choice(300, 6, replace=False):
                own[i] = f"o{p}_{side}_{i}"
            rows.append((2 * p + side, " ".join(own)))
    best, sets = components_of(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = {k: c[1] for (k, _), c in zip(rows, best, strict=True)}
    linked = [k for k, c in want.items() if k != c]
    assert len(linked) > 100 and len(set(want.values())) > 100
    assert np.mean([got[k] == want[k] for k in linked]) >= 0.99 and all(got[k] == want[k] for k in want if want[k] == k)


# ---- secrets ----


def cheapest(value, ranks):
    """Least cost over all segmentations, each segment at its own least cost: recursion over every cut."""
    step = math.log10(secret_scan._alphabet(value))
    low = value.lower()
    plain = low.translate(secret_scan.LEET)

    def segment(i, j):
        n, costs = j - i, [step] if j - i == 1 else []
        if n >= 3:
            if low[i:j] in ranks:
                costs.append(math.log10(ranks[low[i:j]] + 10) + (0 if value[i:j] == low[i:j] else math.log10(2 + n)))
            elif plain[i:j] in ranks:
                costs.append(math.log10(ranks[plain[i:j]] + 10) + math.log10(4 + n))
            pairs = list(zip(low[i:j], low[i + 1 : j]))
            if all(p in secret_scan.NEXT for p in pairs) and (i == 0 or (low[i - 1], low[i]) not in secret_scan.NEXT):
                costs.append(math.log10(40 * n))
            if len(set(value[i:j])) == 1 and (i == 0 or value[i - 1] != value[i]):
                costs.append(step + math.log10(n))
        if n in (4, 6, 7, 8, 10) and secret_scan.DATE.fullmatch(value[i:j]):
            costs.append(2.1 if n == 4 else 4.6)
        if n >= 2 and i >= n and value[i - n : i] == value[i:j]:
            costs.append(math.log10(2))
        return min(costs, default=math.inf)

    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + segment(i, j) for i in range(j)))
    return best[-1]


def test_guess_cost_equals_all_segmentations():
    rng = np.random.default_rng(3)
    parts = ["password", "dragon", "2024", "20240131", "aaaa", "qwerty", "xyz", "p4ss", "Love", "7", "$", "abab", "Zq", "sunshine"]
    long = ["thonortionenrere", "zotaqepuvimox", "Hgtaqzpom", "abcabcabcabc", "Xk3vQ9zLp2RtW8mNqPsUyTbE"]
    values = ["".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(400)] + ["".join(rng.choice(parts + long, 3)) for _ in range(60)]
    for value in [*values, *(x + x for x in long), *(x + "7" + x + x for x in long)]:
        assert secret_scan.guess_cost(value) == pytest.approx(cheapest(value, secret_scan.RANK)), value
        enough = secret_scan.guess_cost(value, enough=6.0)
        assert (enough >= 6.0) == (cheapest(value, secret_scan.RANK) >= 6.0)


def test_a_word_across_sixty_four_code_points_counts():
    head = "Xk3vQ9zLp2RtW8mN" * 3 + "J5hB7cD1fG4sK"
    assert secret_scan.guess_cost(head[:60] + "password" + head[:5]) < secret_scan.guess_cost(head[:60]) + secret_scan.guess_cost("password") + secret_scan.guess_cost(head[:5]) + 1
    assert secret_scan.guess_cost("Ab3$" * 50_000, enough=12.0) >= 12.0


@pytest.mark.parametrize("size", [14, 20, 32])
def test_random_letters_of_one_case_are_secrets(size):
    rng = np.random.default_rng(size)
    costly = secret_scan.Costs()
    for letters in (string.ascii_lowercase, string.ascii_uppercase):
        values = ["".join(rng.choice(list(letters), size)) for _ in range(500)]
        assert sum(costly[v] for v in values) >= 475
    assert secret_scan.find("pwd=hgtaqzpomvexliwbtucd", costly)[1] and secret_scan.find("bearer zotaqepuvimoxarewynobufi", costly)[1]


def test_words_and_blocks_of_any_length_count():
    word = "abstractednessification" * 2
    assert secret_scan.guess_cost("X7" + word, {word: 1}) < 2 * math.log10(36 + 26) + math.log10(11) + 0.1
    block = "Xk3vQ9zLp2RtW8mNqPsUyTbEh5JdGc4F"
    assert secret_scan.guess_cost(block + block) == pytest.approx(secret_scan.guess_cost(block) + math.log10(2))
    assert secret_scan.guess_cost("ab" * 3000, enough=12.0) < 12


def test_planted_secrets_and_prose(spark):
    rng = np.random.default_rng(11)
    letters = list(string.ascii_letters + string.digits + "!$%*")
    secrets = ["".join(rng.choice(letters, 14)) for _ in range(200)]
    prose = ["the", "river", "mountain", "government", "letter", "beautiful", "children", "language"]
    rows = [(i, f"some text, password is {s} and so on") for i, s in enumerate(secrets)]
    rows += [(1000 + i, "the secret is " + " ".join(rng.choice(prose, 6)) + " and password: " + rng.choice(prose[3:])) for i in range(200)]
    got = {r["doc_id"]: r["n_guess"] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] > 0 for i in range(200)) >= 196 and sum(got[1000 + i] > 0 for i in range(200)) == 0


def base_spans(text):
    """The base rule, from its definition."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans_of_all_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in QUERIES["op3_secret_scan"](spark, DATA).collect():
        spans = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))


# ---- toxicity ----


@pytest.mark.parametrize("labels", [[(0, 1), (1, 0)], [(0, 1), (1, 0), (2, 0)], [(0, 1), (1, 1)], [(i, i % 2) for i in range(6)] + [(3, None), (None, 1), (4, 0), (4, 0)]])
def test_few_labels(spark, labels):
    docs = spark.createDataFrame([(i, f"text {i} you fool" if i % 2 else "fine words", 1.0) for i in range(8)] + [(None, None, 1.0)], "doc_id long, text string, raw double")
    rows = toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)


def test_features_from_their_definition():
    lexicon = toxicity.Lexicon(frozenset({b"idiot", b"stup*"}))
    text = "YOU stupid 1d10t! Really, you idiots? idiot @ss. " * 3
    f = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon), strict=True))
    w = re.sub(r"[^A-Za-z0-9@$*]", " ", text).lower().split()
    hits = [i for i, x in enumerate(w) if x == "idiot" or x.startswith("stup")]
    assert (f["n_words"], f["lexicon"], f["lexicon_kinds"]) == (len(w), len(hits), len({w[i] for i in hits}))
    assert f["near_second"] == sum(any(x in ("you",) for x in w[max(0, i - 5) : i + 6]) for i in hits)
    assert f["exclaim_rate"] == 3 / len(w) and f["capital_rate"] == sum(c.isupper() for c in text) / sum(c.isalpha() for c in text)
    assert f["obfuscated_rate"] == 6 / len(w)


def test_toxicity_held_out(spark):
    """On sf0.1: nearly all held-out toxic documents, and hardly a clean one."""
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op4_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").select("predicted", "toxic").collect()
    toxic, clean = [r["predicted"] for r in rows if r["toxic"]], [r["predicted"] for r in rows if not r["toxic"]]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


# ---- mixing ----


def spark_hash(seed, key, text):
    """Spark's xxhash64 of (int, long, string)."""
    h = xxhash.xxh64_intdigest(int(seed).to_bytes(4, "little", signed=True), 42)
    if key is not None:
        h = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), h)
    if text is not None:
        h = xxhash.xxh64_intdigest(text.encode(), h)
    return h - 2**64 if h >= 2**63 else h


def mix_of(rows):
    """(id, text, source) to (size, source_size, target, taken) a row: budgets by resharing, then cuts along the hash order."""
    sizes, by = [len(words(t)) for _, t, _ in rows], defaultdict(list)
    for i, (_, _, s) in enumerate(rows):
        by[s].append(i)
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    total = {s: sum(sizes[i] for i in by[s]) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(total.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
        rest -= sum(target[s] for s in over)
        free -= over
    target |= {s: level * weight[s] for s in free}
    out = [None] * len(rows)
    for s in order:
        budget, before = math.floor(target[s] + 1e-9), 0
        full = budget // total[s] if total[s] else 0
        left = budget - full * total[s]
        for i in sorted(by[s], key=lambda i: (spark_hash(17, rows[i][0], rows[i][1]), rows[i][0], sizes[i])):
            out[i] = (sizes[i], total[s], target[s], full * sizes[i] + max(0, min(sizes[i], left - before)))
            before += sizes[i]
    return out


def test_taken_words(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows += [(7, "again one two", "src1"), (7, "again one two", "src1"), (7, None, None), (9, "three four", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = Counter((r["doc"]["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix(df, keep=["doc_id"]).collect())
    assert got == Counter((k, n, total, round(goal, 6), taken) for (k, _, _), (n, total, goal, taken) in zip(rows, mix_of(rows), strict=True))


# ---- reply trees ----


def test_trees_with_cycles_repeats_and_a_trunk(spark):
    rows = [("a", 1, None, 1.0, "user", "q"), ("a", 2, 1, 2.0, "assistant", "x"), ("a", 5, 6, 1.0, "user", "loop"), ("a", 6, 5, 1.0, "user", "loop"), ("a", 7, 6, 99.0, "user", "leaf on the loop")]
    rows += [("b", 1, None, 0.0, None, "root"), ("b", 2, 1, None, "user", None), ("b", 2, 1, 3.0, "user", "repeated")]
    rows += [("t", i, i - 1 if i else None, 1.0, "user", f"t{i}") for i in range(120)] + [("t", 1000 + i, 119, float(i % 7), "assistant", f"leaf {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "tree string, node long, up long, score double, role string, text string").withColumn("leaf", F.lit(0)).withColumn("place", F.lit(0))
    got = defaultdict(list)
    for r in chat.conversations_formatted(df).orderBy("tree", "place").collect():
        got[r["tree"]].append(r["text"])
    assert got["a"] == ["q", "x"] and got["b"] == ["root", None] and got["t"] == [f"t{i}" for i in range(120)] + ["leaf 6"]


def test_formatted_chars_and_reading_back(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = defaultdict(int)
    for c, _, role, text in rows:
        t, r = (re.sub(r"([\[<\\])", r"\\\1", x or "") for x in (text, role))
        frame = {"user": "[INST][/INST]", "system": "<<SYS>><</SYS>>", "assistant": "</s>"}.get(role)
        want[c] += len(t) + (len(frame) if frame else len("[ROLE][AS][/ROLE]") + len(r))
    assert {r["conv_id"]: r["formatted_chars"] for r in QUERIES["op6_reply_trees"](spark, DATA).collect()} == dict(want)


# ---- shards ----


def test_linked_documents_meet_under_even_counts(spark):
    rows = [(i, f"pair {i % 300}") for i in range(600)] + [(i, "hot") for i in range(600, 1400)] + [(i, f"single {i}") for i in range(1400, 2401)] + [(3, None), (3, ""), (None, "pair 1")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    count = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and len(count) == 40 and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s])) for s in count)
    by = defaultdict(Counter)
    for r in got:
        by[r["grp"]][r["shard"]] += 1
    pairs = [c for c in by.values() if sum(c.values()) in (2, 3)]
    assert sum(len(c) > 1 for c in pairs) <= 0.03 * len(pairs)  # cut edges; by hashes alone 39 of 40 are cut
    hot = max(by.values(), key=lambda c: sum(c.values()))
    assert sum(n for _, n in hot.most_common(20)) >= 0.9 * 800


# ---- languages ----


def test_one_language_and_more_than_sixty_four(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i % 70 // 3)}{j}" for j in range(30)), f"l{i % 70:02d}", 0.5) for i in range(700)], "doc_id string, text string, lang string, score double".replace("doc_id string", "doc_id long"))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(docs.withColumn("lang", F.lit("xx")), F.lit(True)).collect()} == {("xx", 1.0)}
    got = language_id.identify(docs, F.lit(True)).select("lang_pred").distinct().count()
    assert got > 64


def test_decoding_takes_the_nearest_codeword():
    rng = np.random.default_rng(2)
    for n in (2, 4, 9, 80):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n and (np.abs(code.sum(axis=0)) < n).all()
        model = {"languages": [f"l{i}" for i in range(n)], "code": code.astype(np.float32), "weight": rng.uniform(0.5, 1, code.shape[1]).astype(np.float32)}
        for _ in range(20):
            margins = rng.normal(size=code.shape[1])
            loss = [sum(w * math.log1p(math.exp(-c * m)) for c, m, w in zip(row, margins, model["weight"], strict=True)) for row in code]
            assert language_id.decode(model, margins)[0] == f"l{int(np.argmin(loss))}"


# ---- neighbours ----


def test_repeated_query_ids_ties_and_lengths(spark):
    x = [[float(i), 1.0] for i in range(12)]
    rows = [(i, v) for i, v in enumerate(x)] + [(100 + i, x[11]) for i in range(5)] + [(0, [50.0, 1.0]), (200, [1.0]), (None, [1.0, 1.0]), (201, [1.0, None])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("cell", F.lit(1))
    got = ann.search(base, base.filter("vec_id = 0"), probes=1.0, rerank=None).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, i) for i in range(1, 11)]  # the least vector of id 0 asks
    assert len({(r["query_id"], r["vec_id"]) for r in got}) == 10
    tied = ann.search(base, base.filter("vec_id = 4"), k=12, probes=1.0, rerank=None).collect()
    assert len(tied) == 12 and [r["vec_id"] for r in sorted(tied, key=lambda r: r["rank"])[-2:]] in ([100, 101], [11, 100])


def test_recall_of_the_registered_search(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    found = defaultdict(set)
    for r in QUERIES["op9_ivf_pq"](spark, folder).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = []
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - rows[q]) ** 2).sum(axis=1))
        best = [i for i in ids[np.lexsort((ids, far))] if i != q][:10]
        hits.append(len(found[q] & set(best)) / 10)
    assert np.mean(hits) >= 0.9


def test_nearest_are_all_found_on_any_rows(spark):
    """Rows without structure, copies, and groups that codes don't tell apart; few cells and rows at first, so that the bounds decide; against brute force."""
    rng = np.random.default_rng(11)
    plain = rng.normal(size=(900, 48))
    groups = np.concatenate([rng.normal(size=(500, 12)) * 1e-3, rng.normal(size=(200, 12)), rng.normal(size=(12, 12)) * 1e6, np.repeat(rng.normal(size=(2, 12)), 40, axis=0)])
    for x, settings in ((plain, {}), (plain, {"probes": 0.1, "rerank": 5}), (groups[rng.permutation(len(groups))], {"probes": 0.01, "rerank": 5})):
        base = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        got = defaultdict(list)
        for r in ann.search(base, base.filter("vec_id % 10 = 0"), **settings).collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        for q in range(0, len(x), 10):
            far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            best = [i for i in np.lexsort((np.arange(len(x)), far)) if i != q][:10]
            assert sorted(got[q]) == [(n + 1, i, far[i]) for n, i in enumerate(best)]


# ---- tokens ----


def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_long_pieces_and_clashing_names(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abcdefgh"), 3000)), "ab" * 2000, "\n \t " * 500, "é" * 300, ""]
    df = spark.createDataFrame([(f"k{i}", t, 1) for i, t in enumerate(texts)], "doc_id string, text string, n_tokens int")
    own = tiktoken_encoding()
    for r in bpe.tokenized(df, bpe.public_bpe, with_ids=True).collect():
        text = texts[int(r["doc_id"][1:])]
        assert list(r["ids"]) == own.encode_ordinary(text) and r["decoded"] == text
    assert bpe.tokenized(df.limit(0), bpe.public_bpe).count() == 0


# ---- pipeline ----


def passes_rules(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    n, windows = len(w), Counter(zip(w, w[1:], w[2:]))
    repeated = {i + o for i in range(n - 2) if windows[(w[i], w[i + 1], w[i + 2])] > 1 for o in range(3)}
    if n < 50 or 100 * len(repeated) > 50 * n:
        return False
    values = {
        "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_exclamations": text.count("!"), "n_stop_words": sum(x in quality_rules.STOP_WORDS for x in w),
        "n_dup_lines": len(lines) - len(set(lines)), "n_words": n, "n_lines": len(lines),
    }
    share = lambda r: values[r.measure] / max(1, values[r.per])
    return all((r.low is None or share(r) >= r.low) and (r.high is None or share(r) <= r.high) for r in quality_rules.RULES)


def test_pipeline_equals_plain_python(spark):
    """Rows of run() on the smallest documents: rules, pairwise near-duplicates of five words, redaction, cuts along the hash order, and tiktoken."""
    import corpus_pipeline

    rows = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if passes_rules(r["text"])]
    best, _ = components_of([(r["doc_id"], r["text"]) for r in rows], 5)
    rows = [r for r, b in zip(rows, best, strict=True) if b is None or b[1] == r["doc_id"]]
    counts = Counter(w for r in rows for w in re.split("[^a-z]+", r["text"].lower()) if 4 <= len(w) <= secret_scan.LONGEST)
    common = sorted((w for w, n in counts.items() if n >= secret_scan.LEAST_COUNT), key=lambda w: (-counts[w], w))[: secret_scan.DICTIONARY]
    ranks = {}
    for i, w in enumerate([*secret_scan.WORDS, *common]):
        ranks.setdefault(w, i + 1)
    clean = []
    for r in rows:
        base, more = secret_scan.find(r["text"], secret_scan.Costs(ranks))
        assert base == base_spans(r["text"])
        clean.append((r["doc_id"], secret_scan.redact(r["text"], sorted(base + more)), r["source"]))
    own, want = tiktoken_encoding(), Counter()
    for (k, text, _), (size, _, _, taken) in zip(clean, mix_of(clean), strict=True):
        ids = own.encode_ordinary(text)
        row = (k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        if size and taken:
            want[row] += -(-taken // size)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want
