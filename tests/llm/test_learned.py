import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import fertility, langid, mixing, queries, toxicity, urlfilter
from sparkfolio.llm.wordgrams import Grams, number, split

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


# ------------------------------------------------------------------------------ URL filter
def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([i for c in "?#" if (i := tail.find(c)) >= 0], default=len(tail))]
    best = None
    for rule, verdict in urlfilter.RULES:
        at, _, p = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


ADDRESSES = ["http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "www.example.com/en/", "http://example.com", "http://example.com/", "ftp://x.net/es/1", "ftp://xnet/es/1", "http://É.net/fr/?", "http://a.net?x=/es/", None, "", "://", "x://h#f://g/", "http://a.com/e\nn", "http://com/", "http://evilexample.com/en/"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(ADDRESSES)], "page_id long, url string, host string")
    for r in urlfilter.judge(df, slots=1 << 12).collect():
        host, path, best = plain_rule(ADDRESSES[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == (best[1] if best else "allow" if r["score"] >= r["threshold"] else "block")
    assert urlfilter.judge(df.filter("false"), slots=1 << 12).count() == 0


def test_scores_equal_a_plain_markov_model(spark):
    good, bad = ["shop.com/abc", "shop.com/abd"], ["spam.net/es/zz", "spam.net/es/zy", "spam.net/es/zz"]
    rows = [(u, "allow") for u in good] + [(u, "block") for u in bad]
    model = urlfilter.learn(spark.createDataFrame(rows, "said string, verdict string"))
    said = ["shop.com/abz", "spam.net/ab", "qqq"]
    table = urlfilter.table_of(model, 1 << 14)
    got = {r["said"]: r["score"] for r in urlfilter.score(spark.createDataFrame([(s,) for s in said], "said string"), table, slots=1 << 14).collect()}
    counts = [{}, {}]
    for c, urls in zip(counts, (good, bad), strict=True):
        for u in urls:
            p = urlfilter.PAD * 4 + u
            for i in range(4, len(p)):
                for k in range(5):
                    c.setdefault(p[i - k : i], {}).setdefault(p[i], 0)
                    c[p[i - k : i]][p[i]] += 1

    def logp(c, context, char):
        seen = c.get(context, {})
        lower = logp(c, context[1:], char) if context else np.log(1 / urlfilter.ALPHABET)
        n, t = sum(seen.values()), len(seen)
        return np.log((seen.get(char, 0) + t * np.exp(lower)) / (n + t)) if n else lower

    for s in said:
        p = urlfilter.PAD * 4 + s
        known = lambda ctx, ch: any(ctx in c for c in counts)
        total = 0.0
        for i in range(4, len(p)):
            if any(p[i] in c.get("", {}) for c in counts):
                total += logp(counts[0], p[i - 4 : i], p[i]) - logp(counts[1], p[i - 4 : i], p[i])
            else:
                for k in range(1, 5):
                    if known(p[i - k : i], p[i]):
                        esc = [np.log(len(x) / (sum(x.values()) + len(x))) if (x := c.get(p[i - k : i], {})) else 0.0 for c in counts]
                        total += esc[0] - esc[1]
        assert got[s] == pytest.approx(total / len(s), abs=1e-4)


def test_no_gram_is_lost_in_small_tables(spark):
    rng = np.random.default_rng(4)
    rows = [("".join(rng.choice(list("abcdefgh/."), 12)), ["allow", "block"][i % 2]) for i in range(40)]
    model = urlfilter.learn(spark.createDataFrame(rows, "said string, verdict string"))
    said = spark.createDataFrame([(s,) for s, _ in rows], "said string")
    got = [{r["said"]: r["score"] for r in urlfilter.score(said, urlfilter.table_of(model, n), slots=n).collect()} for n in (1 << 14, 1 << 10)]
    assert model.count() > 1 << 10 and len(got[0]) == len({s for s, _ in rows})
    assert got[1] == pytest.approx(got[0], abs=1e-5)


def test_threshold_is_the_best_cut(spark):
    rng = np.random.default_rng(1)
    rows = [("allow", float(x)) for x in rng.normal(0.5, 0.5, 80)] + [("block", float(x)) for x in rng.normal(-0.4, 0.5, 50)]
    cut = urlfilter.threshold(spark.createDataFrame(rows, "verdict string, score double")).first()[0]
    gain = lambda t: sum(s >= t for v, s in rows if v == "allow") / 80 + sum(s < t for v, s in rows if v == "block") / 50
    assert gain(cut) >= max(gain(t / 100) for t in range(-200, 200)) - 0.03
    assert urlfilter.threshold(spark.createDataFrame(rows[:5], "verdict string, score double")).first()[0] == 0.0


# ------------------------------------------------------------------------- quality, language
def plain_repeats(words):
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_op9_base_columns(spark):
    got = {r["doc_id"]: r for r in queries.op9_tokeniser_fertility(spark, SF).collect()}
    for i, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r, repeats = got[i], plain_repeats(words)
        failed = len(words) < 20 or 100 * repeats > 30 * len(words)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeats, failed)
        assert not (failed and r["kept"])


def test_bands_reject_what_stands_out(spark):
    rng = np.random.default_rng(2)
    syllables = ["ther", "in", "ation", "whe", "re", "of", "stin", "ble"]
    normal = lambda: " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(60))
    rows = [(i, normal(), "en") for i in range(60)] + [(100, " ".join("".join(rng.choice(list("qzxvkj"), 12)) for _ in range(20)), "en"), (101, "".join(chr(0x13000 + k) + " " for k in range(60)), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in fertility.rules(df).collect()}
    assert [i for i, r in got.items() if not r["kept"]] == [100] and got[100]["band_failed"]
    assert got[101]["kept"] and got[101]["byte_share"] > 0.5  # nothing to compare with


def plain_bands(rows, pull=10):
    """Who lies outside the band; rows of ((language, script, octave), measures)."""
    outside = set()
    slope = {}
    for script in {g[1] for g, _ in rows}:
        x, y = np.array([(g[2], v["entropy"]) for g, v in rows if g[1] == script]).T
        slope[script] = min(max(np.cov(x, y, bias=True)[0, 1] / x.var(), 0), 1) if x.var() else 0
    for m in fertility.MEASURES:
        step = fertility.STEPS[m]
        trend = lambda g: slope[g[1]] * g[2] if m == "entropy" else 0  # noqa: B023, E731
        round_ = lambda v: np.floor(v / step + 0.5) * step  # noqa: B023, E731
        levels = [{}, {}, {}]
        for g, v in rows:
            value = round_(v[m])
            for level, key, x in zip(levels, (g, g[1:], g[1]), (value, value, round_(value - trend(g))), strict=True):
                level.setdefault(key, []).append(x)
        band = {}
        for g in levels[0]:
            own, near, wide = (np.percentile(x, [25, 50, 75]) for x in (levels[0][g], levels[1][g[1:]], levels[2][g[1]]))
            n, k = len(levels[0][g]), len(levels[1][g[1:]])
            near = (near * k + (wide + trend(g)) * pull) / (k + pull)
            band[g] = (own * n + near * pull) / (n + pull)
        for i, (g, v) in enumerate(rows):
            low, mid, high = band[g]
            room = 0.05 if m == "byte_share" else mid * 0.15
            if v[m] > mid + max((high - mid) * 8, room) + 1e-9 or m != "byte_share" and v[m] < mid - max((mid - low) * 6, mid * 0.06) - 1e-9:
                outside.add(i)
    return outside


def test_op9_bands_against_plain_quartiles(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = fertility.rules(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").orderBy("doc_id").collect()
    model = __import__("sentencepiece").SentencePieceProcessor(model_file=fertility.PIECES)
    rows, at = [], []
    for k, r in enumerate(got):
        tokens = [model.encode(w) for w in (r["text"] or "").encode().decode().split()]
        n = sum(map(len, tokens))
        if n:
            if k < 40:
                ids = [i for t in tokens for i in t]
                share = np.unique(ids, return_counts=True)[1] / n
                assert r["piece_chars"] == pytest.approx(r["word_chars"] / n) and r["entropy"] == pytest.approx(-(share * np.log2(share)).sum()) and r["byte_share"] == pytest.approx(np.mean([model.is_byte(i) for i in ids]))
            rows.append(((r["lang"] or "?", fertility.script_of(r["text"]), int(np.log2(n))), {m: r[m] for m in fertility.MEASURES}))
            at.append(k)
    assert {at[i] for i in plain_bands(rows)} == {k for k, r in enumerate(got) if r["band_failed"]}
    sizes = [list(zip(*rows, strict=True))[0].count(g) for g, _ in rows]
    assert min(sizes) == 1 and sum(n < 30 for n in sizes) > 50
    assert all(r["kept"] == (not r["base_failed"] and not r["band_failed"]) for r in got)
    # the bands see what the base rules don't: symbols in most words
    passed = [r for r in got if not r["base_failed"]]
    junk = [r for r in passed if r["n_symbols"] > 0.1 * r["n_words"]]
    clean = [r for r in passed if r["n_symbols"] < 0.01 * r["n_words"]]
    assert len(junk) > 20 and np.mean([r["band_failed"] for r in junk]) > 0.4 and np.mean([r["band_failed"] for r in clean]) < 0.02
    monkeypatch.setattr(fertility, "BROADCAST_BANDS", 0)
    assert sorted((r["doc_id"], r["kept"]) for r in fertility.rules(docs).collect()) == [(r["doc_id"], r["kept"]) for r in got]


def test_small_groups_are_judged_by_their_script(spark):
    rng = np.random.default_rng(2)
    normal = lambda n: " ".join("".join(rng.choice(["ther", "in", "ation", "whe", "re", "of", "stin", "ble"], rng.integers(1, 4))) for _ in range(n))
    junk = " ".join("".join(rng.choice(list("qzxvkj"), 12)) for _ in range(20))
    rows = [(i, normal(60), "en") for i in range(60)] + [(100, junk, "xx"), (101, normal(60), "yy"), (102, normal(70), "zz")]
    got = {r["doc_id"]: r for r in fertility.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and [i for i, r in got.items() if r["band_failed"]] == [100]


def test_bands_move_smoothly_with_a_groups_size(spark):
    """No group is treated in another way for being a row larger."""
    edge = []
    for n in (1, 5, 29, 30, 31, 200):
        rows = [("xx", "LATIN", 5, 4.0 + 0.01 * (i % 5)) for i in range(n)] + [("en", "LATIN", 5, 3.0 + 0.01 * (i % 5)) for i in range(300)]
        some = spark.createDataFrame(rows, "language string, script string, octave int, piece_chars double")
        some = some.selectExpr("*", "0D byte_share", "4D bpe_chars", "5D entropy")
        got = {r["language"]: r["q_piece_chars"] for r in fertility._bands(some, ["language", "script", "octave"], 10.0).collect()}
        edge.append(got["xx"][1])
    assert edge == sorted(edge) and 3.0 < edge[0] < 3.3 and edge[-1] > 3.9 and abs(edge[3] - edge[2]) < 0.02 and abs(edge[4] - edge[3]) < 0.02


def test_odd_documents_are_judged(odd, none):
    for run in (fertility.rules, langid.identify):
        assert run(odd).count() == len(ODD) and run(none).count() == 0
    by = {r["doc_id"]: r for r in fertility.rules(odd).collect()}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and by[5]["n_words"] == 3000 and by[5]["n_repeat_words"] == 3000 and by[-9]["word_chars"] == 20_000
    lang = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert [lang[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and lang[1]["score"] == 0
    assert all(0 <= r["score"] <= 1 and r["held_out"] == held(i) for i, r in lang.items() if i is not None)


def test_grams_are_those_of_single_words():
    words, at = number([split("Ab abc ab é"), [], split("abc")])
    assert words == [b"ab", b"abc", "é".encode()] and at[0].tolist() == [0, 1, 0, 2] and at[2].tolist() == [1]
    g = Grams(words, (1, 2, 3), 1 << 10, whole=True)
    for i, w in enumerate(words):
        alone = Grams([w], (1, 2, 3), 1 << 10, whole=True)
        assert g.ids[g.starts[i] : g.starts[i] + g.counts[i]].tolist() == alone.ids.tolist()
    table = np.random.default_rng(0).random((1 << 10, 3))
    assert np.allclose(g.sums(table)[1], table[g.of(np.array([1]))[0]].sum(axis=0))


def test_field_marginals_equal_all_labellings(monkeypatch):
    rng = np.random.default_rng(5)
    field = langid.Field(["a", "b", "c"])
    field.moves, field.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores = [rng.normal(size=(n, 3)) for n in (4, 1, 3)]
    table, ends = np.concatenate(scores), np.cumsum([0, 4, 1, 3])
    texts = [np.arange(a, b) for a, b in zip(ends, ends[1:], strict=False)]
    for s, got in zip(scores, field.shares(table, texts), strict=True):
        paths = np.array(np.meshgrid(*[range(3)] * len(s), indexing="ij")).reshape(len(s), -1).T
        weight = np.exp([field.start[p[0]] + sum(s[i, y] for i, y in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
        want = np.array([[weight[(paths == y)[:, i]].sum() for y in range(3)] for i in range(len(s))]) / weight.sum()
        assert np.allclose(got, want.mean(axis=0))
        share, _ = field.marginals(s[None], np.array([len(s)]))
        assert np.allclose(share[0], want)
    long = rng.integers(0, len(table), 1000)
    whole = field.shares(table, [long])[0]
    for stretch in (1, 7, 1000, 5000):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        assert np.allclose(field._long(table, long) / 1000, whole)
    monkeypatch.setattr(langid, "CELLS", 999)
    assert np.allclose(field.shares(table, [long, texts[0]])[0], whole)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    blind = docs.withColumn("lang", F.when(~F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.col("lang")))
    assert sorted(map(tuple, langid.identify(blind).collect())) == sorted(map(tuple, langid.identify(docs).collect()))


def test_rare_labels_do_not_grow_the_field(spark):
    rows = [(i, "the words of this language go here", "en") for i in range(40)] + [(100 + i, "les mots de cette langue sont ici", "fr") for i in range(40)] + [(1000 + i, "junk", f"x{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = langid.sample(df, languages=3)
    assert set(taught) == {"en", "fr", min(x for i, _, x in rows[80:] if not held(i))}
    assert len(langid.sample(df)) == langid.LANGUAGES


def test_language_is_learned_from_whole_texts(spark):
    rng = np.random.default_rng(0)
    words = {"x": ["ka", "lo", "mi"], "y": ["the", "ing", "sch"]}
    say = lambda y, n: " ".join("".join(rng.choice(words[y], 3)) for _ in range(n))
    noise = " ".join("123" for _ in range(400))  # what tells the languages apart begins far behind
    rows = [(i, f"{noise} {say(y, 60)}", y) for i, y in enumerate("xy" * 30)] + [(i, say(y, 20), None) for i, y in enumerate("xy" * 10, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs.unionByName(docs.limit(1))).filter("doc_id >= 1000").collect()}
    assert got == {i: y for i, y in enumerate("xy" * 10, 1000)}
    found = langid.sample(docs.unionByName(docs), per_language=10)
    assert all(len(v) <= 10 * langid.SPANS and max(map(len, v)) <= langid.SPAN for v in found.values())


def test_mixed_words_are_told_apart():
    rng = np.random.default_rng(0)
    make = lambda parts: [["".join(rng.choice(parts, 3)).encode() for _ in range(60)] for _ in range(40)]
    x, y = make(["ka", "lo", "mi"]), make(["the", "ing", "sch"])
    field = langid.train({"x": x, "y": y}, steps=60)
    text = x[0][:30] + y[0][:10]
    words, at = number([text])
    share = field.shares(field.emissions(words), at)[0]
    assert share == pytest.approx([0.75, 0.25], abs=0.05)
    assert langid.train({}).labels == []


# -------------------------------------------------------------------------------- toxicity
def some_net(seed=1, scale=1.0):
    net = toxicity.Network(np.random.default_rng(seed))
    for name in ("words", "chars"):
        setattr(net, name, getattr(net, name) * 20 * scale)
    return net


def plain_logits(net, words, window=toxicity.WINDOW):
    """All windows of one text by the definition: two passes over the whole text, then attention a window."""
    x = net.project(net.vectors(words))
    n, h = len(words), toxicity.HIDDEN
    states = np.zeros((n, 2 * h))
    for d in range(2):
        s = np.zeros((1, h), np.float32)
        for i in range(n) if d == 0 else range(n - 1, -1, -1):
            s = net.step(d, x[d][i + 1 : i + 2], s)[3]
            states[i, d * h : (d + 1) * h] = s[0]
    out = []
    for a in range(max(1, n - window + 1)):
        part = states[a : a + window]
        w = np.exp(np.tanh(part @ net.attend) @ net.point)
        out.append(float((w / w.sum()) @ part @ net.out + net.bias[0]))
    return out


@pytest.mark.parametrize("n", [1, 5, 32, 33, 200])
def test_windows_start_at_every_word(n):
    rng = np.random.default_rng(n)
    net, words = some_net(), [f"w{i}".encode() for i in rng.integers(0, 50, n)]
    distinct, at = number([words])
    (got,) = toxicity.window_logits(net, net.project(net.vectors(distinct)), [at[0] + 1])
    assert len(got) == max(1, n - toxicity.WINDOW + 1)
    assert np.allclose(got, plain_logits(net, words), atol=1e-4)


def test_runs_of_a_long_text_read_on(monkeypatch):
    rng = np.random.default_rng(3)
    net = some_net(scale=0.3)
    distinct, at = number([[f"w{i}".encode() for i in rng.integers(0, 300, 3000)] for _ in range(3)])
    projected = net.project(net.vectors(distinct))
    texts = [x + 1 for x in at] + [np.empty(0, np.int64)]
    whole = [x.copy() for x in toxicity.window_logits(net, projected, texts)]
    monkeypatch.setattr(toxicity, "HELD", 1000)
    alone = list(toxicity.window_logits(net, projected, texts))
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole, alone, strict=True)) and len(whole[-1]) == 1
    monkeypatch.setattr(toxicity, "RUN", 10**6)
    for a, b in zip(whole, toxicity.window_logits(net, projected, texts), strict=True):
        assert np.abs(a - b).max() < 0.02 * max(0.1, np.ptp(b))


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    net = toxicity.Network(rng)
    words = [f"w{i}".encode() * (i % 3 + 1) for i in range(12)]
    ids = rng.integers(1, 13, (5, 6))
    ids[1, 4:] = ids[3, 2:] = 0
    scored = np.zeros((5, 6), bool)
    scored[:, :2] = scored[0, 2:5] = True
    gold = np.array([0, 1, 1, 0, 1], np.float32)
    own, grams = Grams(words, (), toxicity.SLOTS, whole=True), Grams(words, toxicity.SIZES, toxicity.SLOTS)
    seen = {}

    class Keep(toxicity._Adagrad):
        def step(self, name, weights, grad, rows=None):
            seen[name] = (weights, grad.copy(), rows)

    def loss():
        z = net.run(net.project(net.vectors(words)), ids, scored).astype(float)
        return float(np.mean(np.log1p(np.exp(-np.where(gold > 0, z, -z)))))

    for name in ("words", "chars", "out", "point", "attend"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.w, net.u, net.b = ([x.astype(np.float64) for x in y] for y in (net.w, net.u, net.b))
    toxicity._learn(net, Keep(0.1), net.vectors(words).astype(np.float64), own, grams, ids, scored, gold)
    assert len(seen) == 12
    for name, (weights, grad, rows) in seen.items():
        i = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        at = (rows[i[0]], *i[1:]) if rows is not None else i
        before, eps = weights[at], 1e-2
        weights[at] = before + eps
        up = loss()
        weights[at] = before - eps
        down = loss()
        weights[at] = before
        assert (up - down) / (2 * eps) == pytest.approx(float(grad[i]), rel=0.05, abs=2e-4), name


def area(rows):
    """Share of pairs of a toxic and a clean document in which the toxic one scores higher."""
    bad, good = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    return np.mean([[(b > g) + 0.5 * (b == g) for g in good] for b in bad])


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.judge(some, labels).join(labels, "doc_id").collect()
    assert all(r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == held(r["doc_id"]) for r in rows)
    test = [r for r in rows if r["held_out"]]
    bad = [r for r in test if r["toxic"]]
    assert len(test) > 500 and len(bad) > 50
    assert area(test) > 0.9 and np.mean([r["predicted"] for r in bad]) > 0.75
    assert np.mean([r["predicted"] for r in test if not r["toxic"]]) < 0.12


def test_toxicity_is_learned_from_whole_texts(spark):
    rng = np.random.default_rng(5)
    say = lambda n: [f"w{i}" for i in rng.integers(0, 400, n)]
    rows, labels = [], []
    for i in range(240):
        words, toxic = say(1500), i % 4 == 0
        if toxic:
            words[int(rng.integers(900, 1500))] = "nasty" + "abc"[i % 3]  # far behind, among much that is clean
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs, marks).join(marks, "doc_id").filter("held_out").collect()
    assert area(got) > 0.95
    net = toxicity.fit(docs, marks)
    shifted = spark.createDataFrame([(k, " ".join(say(k)) + " " + rows[0][1]) for k in range(0, 60, 7)], "doc_id long, text string")
    moved = [r["score"] for r in toxicity.score(shifted, net).collect()]
    assert max(moved) - min(moved) < 0.15


def test_the_sample_is_bounded(spark):
    docs = spark.range(400).select((F.col("id") % 50).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows = toxicity.sample(docs, labels, per_class=7).collect()
    assert len(rows) == 14 and sum(r["toxic"] for r in rows) == 7 and not any(held(r["doc_id"]) for r in rows)


def test_odd_documents_are_scored(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 1), (6, 1, 0), (6, 0, 0), (None, 1, 1), (7, None, None), (8, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.judge(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.judge(odd, labels.filter("false")).filter("score = 0").count() == len(ODD)
    assert toxicity.score(none, toxicity.train([], [])).count() == 0
    assert toxicity.judge(none, labels).count() == 0


# ---------------------------------------------------------------------------------- mixing
def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.3, 0.2], 500)
    n = rng.integers(1, 900, 500)
    soft = spark.createDataFrame([(int(k), *map(float, q)) for k, q in zip(n, p, strict=True)], "n_tokens long, p0 double, p1 double, p2 double").cache()
    for shares in ([0.9, 0.08, 0.02], [0.2, 0.3, 0.5], [0.0, 0.5, 0.5]):
        want = np.array(shares) * n.sum() * 0.8
        exact = mixing.fit(soft, want, ridge=0.0)[1]
        assert np.abs(exact - want).max() < (0.01 * want.min() if min(shares) else 0.3 * n.sum())
        rate, reached = mixing.fit(soft, want)
        got = np.array([[r["rate"], *(r["rate"] * r["n_tokens"] * r[f"p{i}"] for i in range(3))] for r in soft.withColumn("rate", rate).collect()])
        assert (got[:, 0] >= 0).all() and np.allclose(got[:, 1:].sum(axis=0), reached)
        # a domain that nobody wants keeps what shares documents with those that are wanted
        assert (np.abs(reached - want) < (0.01 * want if min(shares) else 0.3 * n.sum())).all()


def test_mixing_applies_copies(spark, odd, none):
    labels = mixing.domains_of(spark.createDataFrame([(5, 1, 1), (6, 1, 0), (6, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int"))
    assert {r["doc_id"]: r["domain"] for r in labels.collect()} == {5: "toxic", 6: "low", 7: "high"}
    mixed = mixing.mix(odd, labels)
    rows = mixed.collect()
    assert len(rows) == len(ODD) and all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in rows)
    assert all(abs(sum(r[f"p_{d}"] for d in ("high", "low", "toxic")) - 1) < 1e-9 for r in rows)
    out = mixing.apply(odd, mixed)
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(none, labels).count() == 0 and mixing.apply(none, mixing.mix(none, labels)).count() == 0


def test_posteriors_learn_domains(spark):
    rows = [(i, " ".join(["good fine nice", "bad junk poor"][i % 2].split() * 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, ["high", "low"][i % 2]) for i in range(20)], "doc_id long, domain string")
    got = mixing.mix(df, labels, targets={"high": 0.75, "low": 0.25}, total=0.5).collect()
    assert all((r["p_high"] > 0.9) == (r["doc_id"] % 2 == 0) for r in got)
    assert sum(r["rate"] * r["n_tokens"] * r["p_high"] for r in got) == pytest.approx(0.375 * 600, rel=1e-3)
    assert all(r["target_high"] == pytest.approx(0.375 * 600) and r["reached_high"] == pytest.approx(r["target_high"], rel=1e-3) for r in got)


def plain_posterior(model, text):
    """Tokens and posterior by the definition, from the model's weights in plain Python."""
    import re

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    slot = lambda w: signed(xxhash.xxh64_intdigest(w.lower().strip(".,;:!?\"'()").encode(), 42)) % mixing.SLOTS
    text = text or ""
    parts, lines = re.split(r"[\x20\x09-\x0D]+", text), text.split("\n")
    words = [w for w in parts if w]
    marked = sum(bool(re.search(r"[#*$%&|<>]", w)) for w in set(words))
    other = sum(not c.isalpha() and not re.match(r"[\t\n\x0b\f\r ]", c) for c in text)
    dense = [np.log1p(len(words)) / 10, marked / max(1, len(words)), len(set(lines)) / len(lines), len(set(parts)) / len(parts), other / max(1, len(text)), min(1, len(text) / len(parts) / 20)]
    x = model.own + model.weights[:, : len(dense)] @ dense
    for w in set(words):
        x = x + model.weights[:, len(dense) + slot(w)]
    odds = np.exp((x - x.max()) / model.temperature)
    out = np.zeros(len(model.domains))
    out[model.known] = odds / odds.sum() * (1 - mixing.SMOOTH)
    return len(words), out + mixing.SMOOTH * np.array(model.prior)


def test_op8_against_plain_posteriors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = mixing.domains_of(spark.read.parquet(f"{SF}/labels.parquet"))
    domains = sorted(mixing.TARGETS)
    model = mixing.learn(docs, mixing.draw(labels), domains)
    got = {r["doc_id"]: r for r in queries.op8_soft_mixing(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows[::7]:
        n, p = plain_posterior(model, text)
        assert got[doc_id]["n_tokens"] == n and np.allclose([got[doc_id][f"p_{d}"] for d in domains], p, atol=1e-4)
    size = sum(r["n_tokens"] for r in got.values())
    one = next(iter(got.values()))
    for d in domains:
        reached = sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got.values())
        assert reached == pytest.approx(one[f"reached_{d}"], rel=1e-6) and one[f"target_{d}"] == pytest.approx(mixing.TARGETS[d] * size)
        assert reached == pytest.approx(mixing.TARGETS[d] * size, rel=0.05)
    # the rates solve the penalised problem: no small step along any domain makes it cheaper
    p = np.array([[r[f"p_{d}"] for d in domains] for r in got.values()])
    n, r = np.array([x["n_tokens"] for x in got.values()]), np.array([x["rate"] for x in got.values()])
    want = np.array([mixing.TARGETS[d] for d in domains]) * size
    cost = lambda r: (((r * n @ p - want) / want) ** 2).sum() + mixing.RIDGE / size * (n * (r - 1) ** 2).sum()
    for i in range(3):
        for step in (1e-3, -1e-3):
            assert cost(np.maximum(r + step * p[:, i], 0)) >= cost(r) * (1 - 1e-3)


def test_memberships_beat_the_prior_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, domains = spark.read.parquet(f"{sf}/documents.parquet"), sorted(mixing.TARGETS)
    labels = mixing.domains_of(spark.read.parquet(f"{sf}/labels.parquet"))
    # a fifth that neither the fit nor the temperature sees
    apart = F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(5)) == 0
    model = mixing.learn(docs, mixing.draw(labels.filter(~apart)), domains)
    number = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int") - 1
    marks = labels.filter(apart).select(F.col("doc_id").alias("_id"), number.alias("domain"))
    rows = docs.join(marks, F.col("doc_id") == F.col("_id"))
    found = mixing.loss(rows, model, [model.temperature])[model.temperature]
    prior = rows.agg(F.avg(-F.ln(F.element_at(F.array(*map(F.lit, model.prior)), F.col("domain") + 1)))).first()[0]
    assert found < 0.5 * prior


def test_unreachable_targets_stay_an_error(spark):
    """Documents that are nearly all of one domain aren't copied without end."""
    soft = spark.createDataFrame([(100, 0.999, 0.001)] * 50, "n_tokens long, p0 double, p1 double")
    rate, reached = mixing.fit(soft, np.array([2500.0, 2500.0]))
    assert soft.select(rate.alias("r")).agg(F.max("r")).first()[0] < 3 and reached[1] < 20


def test_op8_without_labels(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").filter("false").write.parquet(str(tmp_path / "labels.parquet"))
    rows = queries.op8_soft_mixing(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() and all(r["p_high"] == pytest.approx(1 / 3) and r["rate"] >= 0 for r in rows)
