import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import check

from spanmill.llm import digest, leakage, packing, queries, residue, runs
from spanmill.llm.text import words


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, sf_dir, name):
    if name in queries.ORACLE:
        check(spark, sf_dir, queries.QUERIES[name], queries.ORACLE[name])
    else:
        assert queries.QUERIES[name](spark, sf_dir).count() > 0


# ------------------------------------------------------------------ 1 digests
def test_digests_merge_with_small_rank_error(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.lognormal(10, 3, 4000), np.zeros(500), np.full(500, 7.0)])
    rows = [(i % 3 != 0, i % 5, float(x), i, "c") for i, x in enumerate(rng.permutation(v))] + [(None, 1, 2.0, 10**6, "c"), (True, 1, None, 10**6 + 1, "c"), (True, 1, float("nan"), 10**6 + 2, "c")]
    df = spark.createDataFrame(rows, "k boolean, day int, v double, id bigint, mean string")
    out = digest.percentiles_over_days(df, ["k"], "day", "v", "id", [0.01, 0.5, 0.99])
    got = out.collect()
    assert len(got) == 9
    for r in got:
        x = np.array([a[2] for a in rows if a[0] == r.k and a[2] is not None and a[2] == a[2]])
        assert (r.n, r.n_below, r.n_upto) == (len(x), (x < r.estimate).sum(), (x <= r.estimate).sum())
        assert r.rank_error <= 0.01
    one = digest.build_digests(df, ["k"], "v").groupBy("k").count().collect()
    assert all(r["count"] <= digest.DELTA / 2 + 1 for r in one)


def test_coarse_digests_are_done_again(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i % 2, 0, float(v), i) for i, v in enumerate(rng.lognormal(0, 5, 3000))], "k int, day int, v double, id bigint")
    coarse = digest.certified(df, ["k"], "v", "id", digest.quantiles(digest.build_digests(df, ["k"], "v", 8), ["k"], [0.5, 0.9]))
    assert max(r.rank_error for r in coarse.collect()) > 0.002
    out = digest.percentiles_over_days(df, ["k"], "day", "v", "id", [0.5, 0.9], delta=8, max_rank_error=0.002).collect()
    assert len(out) == 4 and max(r.rank_error for r in out) <= 0.002


def test_chunks_of_a_task_merge(spark, monkeypatch):
    monkeypatch.setattr(digest, "CHUNK_ROWS", 1000)
    run, _ = digest._partial(["k"], {"k": "int"}, 50)
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, 20_000)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + 100) % 3), pa.array(v[i : i + 100])], names=["k", "_value"]) for i in range(0, len(v), 100)]
    out = pa.Table.from_batches(list(run(iter(batches)))).to_pandas()
    assert len(out) <= 3 * 26 and out.weight.sum() == len(v) and out.low.min() == v.min() and out.high.max() == v.max()
    assert abs((out["mean"] * out.weight).sum() - v.sum()) < 1e-6


def test_small_groups_have_exact_medians(spark):
    rows = [(k, float(x)) for k, xs in {1: [5], 2: [1, 2], 3: [3, 1, 9], 4: [1, 2, 10, 20], 5: [4, 4, 4, 4]}.items() for x in xs]
    q = digest.quantiles(digest.build_digests(spark.createDataFrame(rows, "k int, v double"), ["k"], "v"), ["k"], [0.5])
    assert {r.k: r.estimate for r in q.collect()} == {1: 5, 2: 1.5, 3: 3, 4: 6, 5: 4}
    assert digest.build_digests(spark.createDataFrame([], "k int, v double"), ["k"], "v").count() == 0


# --------------------------------------------------------------------- 4 runs
DIM = [(1, "StateActive", "active", "Active", "active"), (2, "StateBlockedSync", "blocked (sync)", "Blocked (sync)", "sync"), (3, "StateX", "x", "X", None)]
SPANS = "e bigint, seq bigint, label string, s bigint, t bigint, code string"


def dim(spark):
    return spark.createDataFrame(DIM, "code int, ident string, name string, name_cap string, label string")


def brute_runs(rows, gap=None):
    key = {"active": 1, "stateactive": 1, "blockedsync": 2, "sync": 2, "stateblockedsync": 2, "x": 3, "statex": 3}
    out = []
    for e, q, lab, s, t in sorted({r[:5] for r in rows if r[0] is not None and r[1] is not None}):
        c = key.get("".join(ch for ch in lab.lower() if ch.isalnum())) if lab else None
        last = out[-1] if out else None
        if last and last[0] == e and c is not None and last[3] == c and last[2] + 1 == q and (gap is None or s - last[5] <= gap):
            last[2], last[4], last[5] = q, last[4] + 1, t
        else:
            out.append([e, q, q, c, 1, t])
    return {tuple(r[:5]) for r in out}


@pytest.mark.parametrize("gap", [None, 2])
def test_runs_against_brute_force(spark, gap):
    rng = random.Random(3)
    rows = []
    for e in (1, 1, 2, 3):
        t = 0
        for q in range(400):
            s = t + rng.choice([0, 0, 1, 5])
            t = s + rng.choice([1, 4])
            if rng.random() < 0.97:
                rows.append((e if len(rows) < 1200 else 9, q, rng.choice(["active", "ACTIVE ", "State​Active", "x", None, "nope"] if rng.random() < 0.3 else ["active"]), s, t, "z"))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += rows[:50] + [(None, 1, "x", 0, 1, None), (4, None, "x", 0, 1, None)]
    df = spark.createDataFrame(rows, SPANS).repartition(5)
    out = runs.collapse_runs(df, dim(spark), "e", "seq", "label", "s", "t", max_gap_ns=gap)
    assert {(r.e, r.first_seq, r.last_seq, r.state_code, r.n_events) for r in out.collect()} == brute_runs(rows, gap)


def test_like_labels_and_nothing(spark):
    df = spark.createDataFrame([(1, 0, "blocked (sync)", 0, 1, ""), (1, 1, "blockd (sync)", 1, None, ""), (1, 2, "zzz", 2, 3, "")], SPANS)
    got = runs.collapse_runs(df, dim(spark), "e", "seq", "label", "s", "t", similarity=0.5).collect()
    assert {(r.first_seq, r.last_seq, r.duration_ns) for r in got} == {(0, 1, 1), (2, 2, 1)}
    assert runs.collapse_runs(spark.createDataFrame([], SPANS), dim(spark), "e", "seq", "label", "s", "t").count() == 0


# ------------------------------------------------------------------ 7 packing
@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=40)
def test_best_fit_never_overfills(sizes):
    where, used = packing.best_fit(np.array(sizes, dtype=np.int64), 50)
    assert all(used <= 50) and len(where) == len(sizes)
    assert used.sum() == sum(sizes) and len(used) <= max(1, 2 * sum(sizes) // 50 + 1)


def test_pack_keeps_all_tokens(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([0, 1, 30, 100, 99, 250, 400]) for i in range(500)} | {-7: None}
    df = spark.createDataFrame(list(sizes.items()) + [(None, 5)], "doc_id bigint, n_tokens bigint")
    out = packing.pack(df, capacity=100).collect()
    total, bins = {}, {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        bins.setdefault(r.container_id, []).append(r.n_tokens)
    assert total == {k: v or 0 for k, v in sizes.items()}
    assert max(map(sum, bins.values())) <= 100
    assert len(bins) <= 1.05 * sum(max(v or 0, 1) for v in sizes.values()) / 100 + 1
    cut = {r.doc_id for r in out if sum(x.doc_id == r.doc_id for x in out) > 1}
    assert cut == {k for k, v in sizes.items() if v and v > 100}
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0


def test_lots_and_rounds_lose_nothing(spark, monkeypatch):
    """Many small lots and rounds: full containers, unique numbers, one at most half empty."""
    monkeypatch.setattr(packing, "LOT_ROWS", 40)
    rng = random.Random(9)
    for choice in ([60] * 9 + [3, 40], range(1, 250), [51]):
        df = spark.createDataFrame([(i, rng.choice(list(choice))) for i in range(2000)], "doc_id bigint, n_tokens bigint").repartition(9)
        placed = spark.createDataFrame(packing.pack(df, capacity=100).toPandas())
        assert tuple(packing.audit(placed, df, 100).first()) == (2000, 0, 0, 0, 0, 0)
        assert placed.where("container_id < 0").groupBy("container_id").count().where("count > 1").count() == 0


@given(st.lists(st.integers(1, 100), max_size=200))
@settings(max_examples=40)
def test_open_bins_are_bounded(used):
    u = np.array(used, dtype=np.int64)
    go = packing.still_open(u, 100, 0.01, 2)
    for room in set(used):
        n = used.count(room)
        assert go[u == room].sum() == (0 if room >= 99 else n if room <= 50 else min(n, 2))


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_tokenizers(name):
    count = packing.encoder(f"/opt/tokenizers/{name}")
    assert count(["", "hello world <|endoftext|>"])[0] == 0 and count(["hello world " * 500])[0] > 500


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "a b c", 9), (1, "a b c", 9), (2, None, 9), (3, "", 9), (None, "x", 9), (4, "word " * 50_000, 9)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(docs).collect()}
    assert got[1] == 3 and got[2] == 0 and got[3] == 0 and got[4] >= 50_000 and len(got) == 4


# ------------------------------------------------------------------ 8 leakage
def brute_match(a, b, edits):
    """Most words of a that also stand in b in order, with few edits among them."""
    best = 0
    level = {(i, j): {0: 0} for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            for e, n in list(level[i, j].items()):
                best = max(best, n)
                steps = [(i + 1, j + 1, e + (a[i] != b[j]), n + (a[i] == b[j]))] if i < len(a) and j < len(b) else []
                if n:
                    steps += [(i + 1, j, e + 1, n)] if i < len(a) else []
                    steps += [(i, j + 1, e + 1, n)] if j < len(b) else []
                elif steps and a[i] != b[j]:
                    steps = []
                for x, y, f, m in steps:
                    if f <= edits and level[x, y].get(f, -1) < m:
                        level[x, y][f] = m
    return best


@pytest.mark.parametrize("seed", range(6))
def test_leaks_against_brute_force(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=40))) for i in range(3)]
    ix = leakage.ItemIndex(items, 7)
    for _ in range(40):
        w = items[rng.randrange(3)][1].split()
        at, n = rng.randrange(15), rng.randrange(17, 26)
        part = w[at : at + n]
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(part))
            part[k : k + 1] = rng.choice([[], ["zz"], [part[k], "yy"]])
        doc = rng.choices(vocab, k=5) + part + rng.choices(vocab, k=5)
        ids = [ix.vocab.get(x, -1) for x in doc]
        arr = np.array(ids)
        arr[arr < 0] = -2 - np.arange((arr < 0).sum())
        got = set(leakage.leaked(ix, arr.tolist(), list(ix.hits(arr)), 20, 2))
        want = {k for k, (_, t) in enumerate(items) if brute_match([ix.vocab[x] for x in t.split()], arr.tolist(), 2) >= 20}
        assert got == want


def test_leak_normalisation_and_cases(spark):
    text = "The quick brown fox jumps over a lazy dog while seven half-empty boxes of liquor stand near my old waltz and nobody cares about them"
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)
    broken = text.replace("brown", "bro-\nwn").replace("waltz", "wal­tz").replace(" old ", "\n> old ")
    html = "<p>" + text.replace("fox", "<b>fox</b>").replace(" my ", "&nbsp;my ") + "</p>"
    short = " ".join(text.split()[:18])
    two = text.replace("fox", "cat").replace("seven ", "")
    three = text.replace("jumps", "sat").replace("while", "zz").replace("liquor", "milk").replace("old", "new")
    docs = [(1, text.upper()), (2, wide), (3, broken), (4, html), (5, short), (6, two), (7, three), (8, None), (9, ""), (10, ("x " * 60_000) + text), (None, text), (1, text)]
    d = spark.createDataFrame([(*r, "e") for r in docs], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(77, text), (77, text), (78, None), (None, "z"), (79, "too short")], "item_id bigint, text string")
    want = {(k, 77) for k in (1, 2, 3, 4, 6, 10)}
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, items).collect()} == want
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, items, block_chars=100).collect()} == want
    assert leakage.find_leaks(d, items.where("false")).count() == 0 and leakage.find_leaks(d.where("false"), items).count() == 0
    assert leakage.without_leaked(d, leakage.find_leaks(d, items)).where("doc_id is not null").count() == 4
    assert words("d’Or l'eau x_y 1.5 é") == ["d", "or", "l", "eau", "x", "y", "1", "5", "é"]


# ------------------------------------------------------------------ 9 residue
RESIDUE = [
    "Please enable JavaScript to view this page.",
    "<h2>502 Bad Gateway</h2><hr>\nproxy/1.2",
    "My pump leaks.\n\nHello {{user.name}}, you have a new answer.\n\nBye.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do.",
    "asdf asdf asdf asdf asdf",
    "Steps to reproduce:\n1.\n2.\nExpected result:\nActual result:",
    "Title: ${title}\nBody: ${body}",
    "Regards, <your name here>",
    "[Describe what you have tried so far]",
    "Fehler 404 – Seite nicht gefunden.",
    '{"error": {"code": 500, "message": "could not load post 8"}}',
    "YOUR SESSION HAS EXPIRED. SIGN IN AGAIN TO CONTINUE. [a1b2c3]",
    "404. That's an error. The requested URL was not found on this server.",
    "We're sorry, but something went wrong.",
    "HTTP Error 503. The service is unavailable.",
    "Page under construction",
    "Hello %FIRSTNAME%, your order",
    "Unable to connect to the database.",
]
CONTENT = [
    'My client sees "Please enable JavaScript" although scripts are on.',
    "I keep getting a 502 Bad Gateway from the proxy as soon as it restarts, any idea?",
    "```\n<h1>{{ title }}</h1>\n```\n\nWhy does this print braces?",
    "What is the difference between `${a}` and `$(a)` in a shell script?",
    "Where does the custom of using lorem ipsum for a mock-up come from?",
    "A maintenance page with status 503 is right here, since crawlers come back later.",
    "Steps to reproduce:\n1. open it\n2. close it\nExpected result:\nnothing\nActual result:\na crash",
    "The TODO list in the app loses its entries after every update.",
    "No.",
    "404",
    "<pre><code>Hello ${x}, you have ${y} items</code></pre>",
    "See the [manual](http://a.example/x) of the pump.",
    "500 Internal Server Error after upgrading to 3.0",
    "Fatal error: out of memory when compiling the kernel with 2 GB",
    "Error 1045: access denied for the root user on the new server",
    "Access denied. You need the backups group in order to read the share",
    "",
    None,
]


@pytest.mark.parametrize("text", RESIDUE)
def test_rule_finds(text):
    assert any(residue.units(text).values())


@pytest.mark.parametrize("text", [t for t in CONTENT if t])
def test_rule_spares(text):
    assert not any(residue.units(text).values())


def test_residue_spreads_to_near_duplicates(spark):
    near, letters = "Please enable JavaScript to view this odd page.", "abcdefghijklmnopqrstuvwxyz"
    texts = [*RESIDUE, "Title: undefined\nBody: undefined", near, "Title: a pump", *CONTENT]
    rows = [(i, t, True) for i, t in enumerate(texts)]
    rows += [(0, texts[0], True), (None, "Lorem", True), (900, "word " * 50_000, True), (901, " ".join(a + b + c + " of" for a in "bdfghk" for b in letters for c in letters), False)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, trust boolean")
    found = residue.find_residue(df)
    got = {r.doc_id: r for r in found.collect()}
    # one word over and over is filler at any length, a long text of many words is not
    assert set(got) == {*range(len(RESIDUE) + 2), 900}
    assert got[len(RESIDUE)].n_spread == 2 and got[0].n_spread == 0
    assert residue.find_residue(df.where("false")).count() == 0
    assert {r.doc_id for r in residue.without_residue(df, found).collect()} == {*range(len(RESIDUE) + 2, len(texts)), 901, None}


def edited(rng, text, words, chars):
    w = text.split()
    for _ in range(words):
        i = rng.randrange(len(w))
        w[i : i + rng.randrange(2)] = [rng.choice(("module", "quietly", "seven", "gateway"))] * rng.randrange(2)
    t = list(" ".join(w))
    for _ in range(chars):
        i = rng.randrange(len(t))
        t[i : i + rng.randrange(2)] = [rng.choice("abcdefgh ,.")] * rng.randrange(2)
    return "".join(t)


NOTICES = [
    "thank you for your interest in our community, your account is being reviewed and you will be told by mail once it is open.",
    "the template of this entry was met by an unexpected condition and gave up before any part of the thread could be shown.",
    "this question was asked by § on §.",
    "we use a small file on your device to remember your settings.",
]


@pytest.mark.parametrize("words,chars", [(1, 0), (2, 0), (3, 0), (0, 1), (0, 2), (0, 3)])
def test_tables_reach_near_duplicates(words, chars):
    """Recall of the SimHash tables among pairs of the stated similarity, over edits of notices no rule knows."""
    assert not any(v for t in NOTICES for v in residue.units(t).values())
    rng = random.Random(7)
    pairs = []
    for _ in range(3000):
        a = rng.choice(NOTICES)
        b = edited(rng, a, words, chars)
        p, q = residue.grams(a), residue.grams(b)
        if a != b and len(p & q) >= 0.8 * len(p | q):
            pairs.append((a, b))
    assert len(pairs) > 200
    (sa, wa), (sb, wb) = residue.simhashes(pa.array([a for a, _ in pairs])), residue.simhashes(pa.array([b for _, b in pairs]))
    near = np.unpackbits((sa ^ sb).view(np.uint8), axis=1).sum(axis=1) <= residue.MAX_DISTANCE
    met = [bool(set(x.tolist()) & set(y.tolist())) for x, y in zip(residue.table_keys(sa, wa), residue.table_keys(sb, wb))]
    assert (near & np.array(met)).mean() >= 0.9


def test_labels_spread_over_components(spark):
    """Against all pairs compared by text similarity alone."""
    rng = random.Random(3)
    base = "the render service met an unexpected condition while it was building the page and gave up before any part of the thread could be shown here"
    texts = ["{{x}} " + base]
    while len(texts) < 60:
        texts.append("§ " + edited(rng, rng.choice(texts)[2:].removeprefix("x}} ").strip() if rng.random() < 0.5 else base, rng.choice((1, 2)), 0))
    shown = [next(iter(residue.units(t)))[0] for t in texts]
    alike = lambda a, b: len(residue.grams(a) & residue.grams(b)) >= 0.8 * len(residue.grams(a) | residue.grams(b))
    found, new = {0}, {0}
    while new:
        new = {i for i, t in enumerate(shown) if i not in found and any(alike(t, shown[j]) for j in new)}
        found |= new
    assert len(found) > 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id for r in residue.find_residue(df).collect()}
    assert got <= found and len(got) >= 0.9 * len(found)


def test_propagation_replaces_rules_held_out(spark, sf_dir):
    docs = spark.createDataFrame([(i, f"Dear {s}, thanks for your question.") for i, s in enumerate(("{{name}}", "${name}", "@@name@@", "[[name]]", "undefined"))], "doc_id bigint, text string")
    got = residue.find_residue(docs, held_out=frozenset(f"slot {i}" for i in range(1, len(residue.SLOT_RULES)))).collect()
    assert len(got) == 5 and sum(r.n_spread for r in got) == 4


_LONG = "The pump in the cellar runs all night although the tank above it is full and the valve between them was replaced by the plumber only two weeks ago. It is loud, and the neighbours complain about it. "


@pytest.mark.parametrize(
    "text",
    [
        _LONG + "Hello {{first_name}}, your parts are on the way.",
        _LONG.replace(". ", ", ").strip(" ,") + " and the order ${order} is on the way",
        _LONG + "[INSERT DATE]",
        _LONG + "Please enable JavaScript to continue.",
        "Some text. Please enable JavaScript to continue.",
        "\n\n".join([_LONG, _LONG, "Some text. Please enable\nJavaScript to continue.", _LONG]),
    ],
)
def test_rule_finds_residue_within_long_lines_and_texts(text):
    assert any(residue.units(text).values())


@pytest.mark.parametrize(
    "text",
    [
        _LONG,
        _LONG * 200,
        _LONG + 'The page says "Please wait. Please enable JavaScript to continue. Thanks." and nothing more.',
        _LONG + "Then it shows this message: nothing to see. Now I see an error. Please try again later.",
    ],
)
def test_rule_spares_long_lines_that_talk_about_notices(text):
    assert not any(residue.units(text).values())
