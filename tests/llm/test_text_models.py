import math
import random

import numpy as np
import pytest

from corrvox.llm import decontam, html_text, language_id, toxicity

DATA = "/root/testdata/sf0.01"


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    model = language_id.new_model(["a", "b", "c"], 4, 1)
    x = rng.integers(1, 255, (5, 9)).astype(np.uint8)
    x[1, 6:] = 0
    y = np.array([0, 1, 2, 1, 0])
    _, grads = language_id.loss_and_gradients(model, x, y)
    for a, g in zip(model.arrays(), grads, strict=True):
        flat = a.reshape(-1)
        for k in np.argsort(-np.abs(np.asarray(g).reshape(-1)))[:3]:
            old, losses = flat[k], []
            for e in (0.01, -0.01):
                flat[k] = old + e
                losses.append(language_id.loss_and_gradients(model, x, y)[0])
            flat[k] = old
            assert (losses[0] - losses[1]) / 0.02 == pytest.approx(np.asarray(g).reshape(-1)[k], rel=0.1, abs=2e-4)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [d for d, r in got.items() if r.held_out]
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    rows = [(k, "der die das und " * 5, "de") for k in range(20)] + [(k, "le la les et une " * 5, "fr") for k in range(20, 40)] + [(50, None, "de"), (51, "12 !?", None), (52, "", "fr"), (None, "und der das", None)]
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out[50] == out[51] == out[52] == ("und", 0.0) and out[1][0] == "de" and out[21][0] == "fr" and out[None][0] == "de"
    none = language_id.language_id(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert none[0].lang_pred == "und"
    assert language_id.language_id(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert not any(p and not t for p, t in held)
    assert sum(p for p, t in held) >= 0.7 * sum(t for _, t in held)


@pytest.fixture(scope="module")
def channel():
    text = (" the idiot and the clown were stupid a moron said in the trash of pathetic worthless losers " * 50).encode()
    c = toxicity._FOLD[np.frombuffer(text, np.uint8)].astype(int)
    return toxicity.Channel(np.bincount((c[:-2] * 64 + c[1:-1]) * 64 + c[2:], minlength=64**3))


@pytest.mark.parametrize(("seen", "meant"), [("1d10t", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiiiioot", "idiot"), ("$tup1d", "stupid"), ("cl0wn!!", "clown!!"), ("p@thet1c", "pathetic"), ("the", "the")])
def test_deobfuscation(channel, seen, meant):
    assert channel.restore(f"and {seen} of") == f"and {meant} of"


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()} == {(1, 0.0, 0), (2, 0.0, 0), (None, 0.0, 0), (3, 0.0, 0)}


def aligned(words, item, window=13, share=0.8):
    best = None
    w = min(window, len(item))
    for shift in range(1 - len(item), len(words)):
        eq = [0 <= shift + j < len(words) and words[shift + j] == x for j, x in enumerate(item)]
        at = [s for s in range(len(item) - w + 1) if sum(eq[s : s + w]) >= share * w - 1e-9]
        if at and w:
            best = max(best or (0,), (sum(eq), at[-1] - at[0] + w, -(shift + at[0])))
    return best


def decontam_corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    items = [(k, [rng.choice(vocab) for _ in range(n)]) for k, n in enumerate([*range(1, 31), 5, 6, 7, 10, 11, 12])]
    docs = []
    for d in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if d % 5:
            p = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 4)):
                p[rng.randrange(len(p))] = rng.choice(vocab)
            at = rng.randint(0, len(w))
            w[at:at] = p
        docs.append((d, w))
    return docs, items


@pytest.mark.parametrize("seed", [7, 8])
def test_decontamination_same_as_brute_force(spark, seed):
    docs, items = decontam_corpus(seed)
    a = spark.createDataFrame([(d, " ".join(w).upper() if d % 5 == 0 else "\n".join(w), 1) for d, w in docs] + [(900, None, 1), (901, "", 1)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(k, " ".join(w), 1) for k, w in items] + [(500, None, 1), (501, "", 1), (3, " ".join(items[3][1]), 1)], "item_id long, text string, key int")
    got = {(r.doc_id, r.item_id): (r.n_equal, r.n_words, -r.start_word) for r in decontam.find_contamination(a, b).collect()}
    want = {(d, k): m for d, w in docs for k, i in items if (m := aligned(w, i))}
    assert got == want and len({len(dict(items)[k]) for _, k in want}) > 25
    bad = {d for d, _ in want}
    assert {r.doc_id for r in decontam.decontaminate(a, b).collect()} == {d for d, _ in docs if d not in bad} | {900, 901}
    assert decontam.find_contamination(a, b.where("false")).count() == 0
    assert decontam.find_contamination(a.where("false"), b).count() == 0
    assert decontam.decontaminate(a.where("false"), b).columns == a.columns


def test_decontamination_sql_with_short_items(spark):
    import duckdb
    import pandas as pd

    docs, items = decontam_corpus(9)
    c = duckdb.connect()
    c.register("documents", pd.DataFrame([(d, " ".join(w)) for d, w in docs], columns=["doc_id", "text"]))
    c.register("benchmark", pd.DataFrame([(k, " ".join(w)) for k, w in items], columns=["item_id", "text"]))
    got = {r[:2]: r[2:] for r in c.execute(decontam.oracle_sql()).fetchall()}
    assert got == {(d, k): (-m[2], m[1], m[0]) for d, w in docs for k, i in items if (m := aligned(w, i))}


def test_masks_hit_every_passing_window():
    for n in range(1, 20):
        masks, hits = decontam.plan_masks(n)
        wide = min(13, n)
        assert hits >= 1 and hits == decontam.least_hits(wide, decontam.need_of(wide, 0.8), masks)
    for window, share in ((50, 0.8), (30, 0.5), (8, 1.0)):
        masks, hits = decontam.plan_masks(100, window, share)
        need = decontam.need_of(window, share)
        rng = random.Random(1)
        for _ in range(300):
            out = set(rng.sample(range(window), window - need))
            assert sum(all(at + k not in out for k, c in enumerate(m) if c == "1") for m in masks for at in range(window - len(m) + 1)) >= hits


def test_decontamination_rows_and_long_texts(spark):
    item = " ".join(f"q{i}" for i in range(20))
    far = "x y z " * 60_000 + item
    rows = [(1, item), (1, "clean text"), (None, "a " + item), (None, "also clean"), (2, far), (2, far), (3, "alpha beta gamma delta")]
    a = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, "alpha beta gamma delta")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words, r.n_equal) for r in decontam.find_contamination(a, b).collect()}
    assert got == {(1, 1, 0, 20, 20), (None, 1, 1, 20, 20), (2, 1, 180_000, 20, 20), (3, 2, 0, 4, 4)}
    # Rows that repeat an identifier are judged each by its own text.
    assert sorted(decontam.decontaminate(a, b).collect(), key=repr) == sorted([(1, "clean text"), (None, "also clean")], key=repr)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- x --><article><h1>The &amp; title</h1><p>One
  two&nbsp;three.<p>Four <b>five</b><br>six<div class=ad>Buy</div><ul><li>item</ul><form>mail<input></form><section class="comments"><p>First!</p></section></article>
<aside>More</aside><footer>&copy; x</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "The & title\nOne two three.\nFour five six\nitem"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html><body></body></html>") == ""
    long = "text of the body that is long enough " * 4
    plain = f"<body><div id=menu><a href=x>a</a></div><div><p>{long}</p><p>{long}</p></div><div class='footer'>c</div></body>"
    assert html_text.main_text(plain) == "\n".join([long.strip()] * 2)
    assert html_text.main_text("no markup &lt;at&gt; all") == "no markup <at> all"


LONG = "This is a long paragraph of running text that goes on for a while."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='content has-sidebar'><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
        (f"<article><section class='related-work'><p>{LONG}</p></section></article>", LONG),
        (f"<article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p></article>", f"Title\n{LONG}"),
        (f"<article><div class='header'><h1>Title</h1></div><p>{LONG}</p></article>", f"Title\n{LONG}"),
        (f"<body><div class='ad'>Buy now<div><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
        (f"<body><form><div><p>{LONG}</p><p>{LONG}</p></div></form></body>", f"{LONG}\n{LONG}"),
        (f"<div>Home</div><div>News</div><div>About us</div><h1>Title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p><div>Imprint</div><div>Contact</div>", f"Title\n{LONG}\nShort one.\n{LONG}"),
        (f"<article><p>{LONG}</p><p>One.</p><aside>More of it</aside><p>The end.</p></article>", f"{LONG}\nOne.\nThe end."),
        (f"<article><p>{LONG}</p><div class=share>x</div><div>Tweet</div><div>Mail</div></article>", LONG),
        (f"<article><p>{LONG}</p><p>see the <span class='ad-hoc'>odd</span> case</p></article>", f"{LONG}\nsee the odd case"),
        (f"<article><p class=ad>Buy<p>{LONG}<ul><li class=ad>Buy<li>item two</ul></article>", f"{LONG}\nitem two"),
        (f"<article><p>{LONG}</p></article><article><p>Short.</p></article>", f"{LONG}\nShort."),
        (f"<div><p>{LONG}</p></div><div class='comments'><p>{LONG}</p><p>{LONG}</p></div>", LONG),
        (f"<p title='a > b'>{LONG}</p><p>1 < 2 and 3 > 2.</p>", f"{LONG}\n1 < 2 and 3 > 2."),
        (f"<article><p>{LONG}</p><ul><li><a href=a>one more</a><li><a href=b>two more</a><li><a href=c>three more</a><li><a href=d>four</a></ul></article>", LONG),
        (f"<div class='post'><p>{LONG}</p></div><div class='comments'>{f'<p>{LONG}</p>' * 12}</div>", LONG),
        (f"<div class='post'><p>{LONG}</p></div><div id='discussion'>{f'<p>{LONG}</p>' * 12}</div>", LONG),
        (f"<article><p>{LONG}</p></article><article class='comment'><p>{LONG}</p></article>", LONG),
        (f"<div class='cookieBanner'><p>We use cookies.</p></div><div><p>{LONG}</p></div>", LONG),
        ("<p>A long line of text that is about a <label>thing</label> more.</p>", "A long line of text that is about a thing more."),
        (f"<p>{LONG} {LONG}</p><div class='ad'>Buy</div><p>Final words.</p>", f"{LONG} {LONG}\nFinal words."),
        (f"<article><p>{LONG}</p><aside>More of it</aside><ul><li>milk</li><li>eggs</li><li><div>bread</div></li></ul></article>", f"{LONG}\nmilk\neggs\nbread"),
        (f"<article><p>{LONG}</p><div class='ad'>Buy</div><p>so it was</p><p>the end</p></article>", f"{LONG}\nso it was\nthe end"),
        ("<script>never closed <p>x", ""),
        ("<p>x<p>y", "x\ny"),
        ("&lt;b&gt; a&amp;b &#233;<br>c", "<b> a&b é c"),
    ],
)
def test_pages(page, want):
    assert html_text.main_text(page) == want


def test_surge_and_dive_same_as_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        w = [rng.choice((0, 0, 1, 5, 30, 90)) for _ in range(rng.randint(1, 25))]
        window, threshold = rng.randint(1, 4), rng.choice((1, 6, 31, 80))
        inside = [any(sum(w[k : k + window]) >= threshold for k in range(max(0, i - window + 1), i + 1)) for i in range(len(w))]
        want, i = [], 0
        while i < len(w):
            if inside[i]:
                z = i
                while z < len(w) and inside[z]:
                    z += 1
                heavy = [k for k in range(i, z) if w[k]]
                want.append((heavy[0], heavy[-1] + 1))
                i = z
            i += 1
        assert html_text.stretches_of(w, window, threshold) == want


def test_the_distribution_decides():
    """Text that names and elements alone would give, and what surge and dive keep of it."""
    def by_names(page):
        lines, suspects = html_text.lines_of(page)
        html_text.judge(lines, suspects)
        inside = any(x.container for x in lines)
        return "\n".join(x.text for x in lines if x.text and not suspects[x.suspect].hidden and (x.container > 0 or not inside))

    links = "".join(f"<li><a href=x{k}>another story {k}</a></li>" for k in range(6))
    for page, want in (
        (f"<div>Home</div><div>News</div><div>Sport</div><div>Log in</div><p>{LONG}</p><p>{LONG}</p><div>Imprint</div><div>About</div>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><ul>{links}</ul></article>", LONG),
        (f"<article><ul>{links}</ul></article><div><p>{(LONG + ' ') * 6}</p><p>{(LONG + ' ') * 6}</p></div>", "\n".join([((LONG + " ") * 6).strip()] * 2)),
        (f"<main><div>Share</div><div>Save</div><div>Print</div><h1>Title</h1><p>{LONG}</p></main>", f"Title\n{LONG}"),
    ):
        assert html_text.main_text(page) == want != by_names(page)


def test_main_text_same_as_brute_force():
    """Every line against all blocks that hold it, on pages made at random."""
    rng = random.Random(11)
    bits = ["<p>" + LONG + "</p>", "<p>Short one.</p>", "<div>Menu</div>", "<div>Imprint</div>", "<li><a href=x>link text here</a>", "<h2>Head</h2>", "<aside>side</aside>", "<div class=ad>Buy</div>", "<article>", "</article>", "<div class=comments><p>" + LONG + "</p></div>", "<ul><li>milk</ul>"]
    for _ in range(300):
        page = "".join(rng.choices(bits, k=rng.randint(1, 25)))
        lines, suspects = html_text.lines_of(page)
        html_text.judge(lines, suspects)
        own = [x for x in lines if x.text and not suspects[x.suspect].hidden]
        inside = any(x.container for x in own)
        w = []
        for x in own:
            free = len(x.text) - x.links
            article = x.container and (x.prose or x.solid)
            scale = 1 if article else (1 if x.solid else 4) * (4 if inside and not x.container else 1)
            w.append(0 if 2 * x.links > len(x.text) else free + 40 if article else math.ceil(free / scale))
        n = len(own)
        blocks = [sum(w[k : k + 3]) for k in range(n)]
        least = min(80, max(blocks, default=0))
        held = [any(blocks[k] >= least for k in range(max(0, i - 2), i + 1)) for i in range(n)] if any(w) else [False] * n
        firm = [w[i] > 0 and (own[i].solid or own[i].prose and bool(own[i].container)) for i in range(n)]
        keep, i = set(), 0
        while i < n:
            z = i
            while z < n and held[z]:
                z += 1
            if z > i:
                first = [k for k in range(i, z) if w[k] and (firm[k] or own[k].heading)]
                last = [k for k in range(i, z) if firm[k]]
                heavy = [k for k in range(i, z) if w[k]]
                # The first line that is text or a heading, among lines that weigh something or follow one that does.
                start = [k for k in range(heavy[0], heavy[-1] + 1) if firm[k] or own[k].heading]
                a, b = (start[0], last[-1]) if first and last and start[0] <= last[-1] else (heavy[0], heavy[-1])
                while a and own[a - 1].heading and a - 1 not in keep:
                    a -= 1
                keep |= set(range(a, b + 1))
            i = z + 1
        assert html_text.main_text(page) == "\n".join(own[k].text for k in sorted(keep))


@pytest.mark.parametrize("bit", ["<p a='", "<a href=\"", "<div class=ad>", "<!--", "<![CDATA[", "<script ", "<b <", "<", "</p", "'\"<x ", "<div><article>", "</div></b>", "<?"])
def test_broken_markup_takes_linear_time(bit):
    import time

    def seconds(n):
        t = time.process_time()
        html_text.main_text(bit * n + "end.")
        return time.process_time() - t

    assert min(seconds(40_000) for _ in range(2)) < 20 * min(seconds(4_000) for _ in range(3)) + 0.1


def test_very_long_page():
    page = f"<article>{''.join(f'<p>{LONG} {k}.</p>' for k in range(20_000))}</article>"
    assert html_text.main_text(page).count("\n") == 19_999


def test_extract_from_empty_table_and_clashing_columns(spark):
    rows = [(1, "u", f"<p>{LONG}", "mine", 3)] * 2
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert [tuple(r) for r in got] == [(1, "u", LONG, len(LONG))] * 2
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extract_edges(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, 6), (None, "v", "<p>x", 7)]
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert got[2] == (None, "", 0) and got[None] == ("v", "x", 1) and got[1][2] == len(got[1][1])


def test_long_spans_are_decoded(channel):
    words = ["the", "idiot", "and", "the", "stupid", "clown"] * 8
    seen = "_".join(w.replace("i", "1").replace("o", "0") for w in words)
    assert len(seen) > 200 and channel.restore(f"of {seen} of").count("idiot") == channel.restore(f"of {seen} of").count("stupid") == 8
    apart = " ".join("".join(words))
    assert len(apart) > 200 and channel.restore(apart).count("idiot") == 8
    assert len(channel.restore("x" * 100_000)) > 0  # linear in the length


@pytest.mark.parametrize(("seen", "meant"), [("1 d 1 0 t", "idiot"), ("5 t u p 1 d", "stupid"), ("i.d.i.0.t", "idiot"), ("a s s", "ass"), ("a$$", "ass"), ("dumba55", "dumbass"), ("idio7.", "idiot."), ("idio7", "idiot"), ("2 0 1 9", "2 0 1 9"), ("v2.0", "v2.0")])
def test_mixed_short_and_final_disguises(seen, meant):
    text = (" the idiot and the clown were stupid a moron said ass in the trash of dumbass losers and of ass and " * 50).encode()
    c = toxicity._FOLD[np.frombuffer(text, np.uint8)].astype(int)
    channel = toxicity.Channel(np.bincount((c[:-2] * 64 + c[1:-1]) * 64 + c[2:], minlength=64**3))
    assert channel.restore(f"and {seen} of") == f"and {meant} of"


def test_covering_same_as_brute_force():
    """Greedy covering: at each step the feature with the largest gain, over plain sets."""
    rng = random.Random(6)
    for _ in range(20):
        words = [f"w{k}" for k in range(12)]
        toxic = [{w for w in words if rng.random() < 0.3} for _ in range(60)]
        clean = [{w for w in words[:6] if rng.random() < 0.1} for _ in range(80)]
        bad = {w: sum(w in s for s in toxic) for w in words}
        names = sorted(w for w in words if bad[w] >= 3)
        good = {w: sum(w in s for s in clean) for w in names}
        sample = toxicity.Sample(names, np.array([bad[w] for w in names]), np.array([good[w] for w in names]), [np.array([k for k, w in enumerate(names) if w in s], np.int64) for s in toxic], [toxicity.min_hashes(s) for s in toxic], {}, len(clean))
        got = toxicity.fit_scorer(sample, 0.4)
        at_rate = 0.6 * 60 / (0.4 * 80)
        exact = {w: (bad[w] + 0.4) / (bad[w] + good[w] * at_rate + 1) for w in names}
        left, chosen = list(toxic), []
        while True:
            gain = {w: sum(w in s for s in left) - 3 * good[w] for w in names if exact[w] >= 0.9 and w not in chosen and sum(w in s for s in left) >= 3}
            if not gain or max(gain.values()) < 3:
                break
            chosen.append(max(gain, key=lambda w: (gain[w], exact[w], -len(w), w)))
            left = [s for s in left if chosen[-1] not in s]
        assert set(chosen) <= set(got.weights) and all(got.weights[w] == pytest.approx(exact[w]) for w in chosen)
        share = len(left) / 60
        assert got.base == pytest.approx(0.4 * share / (0.4 * share + 0.6))


def test_toxicity_repeats_and_clashing_columns(spark):
    bad, fine = "you are an idiot and a moron", "a lovely day in the park"
    rows = [(k, f"{bad} {k}" if k % 2 else f"{fine} {k}", 1, 1) for k in range(60)] + [(1, f"{fine} 1", 1, 1), (1, f"{bad} 1", 1, 1), (None, bad, 1, 1), (99, "word " * 40_000 + bad, 1, 1)]
    labels = [(k, 1, k % 2) for k in range(60)] + [(1, 1, 0), (None, 1, 1), (2, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, y int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, lab).collect()
    again = toxicity.toxicity(docs.repartition(3), lab.repartition(2)).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr) and len(got) == len(rows)
    assert {r.predicted for r in got if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2 and r.doc_id != 1} == {1}
    assert {r.predicted for r in got if r.doc_id is None or r.doc_id == 99} == {1} and {r.predicted for r in got if r.doc_id is not None and r.doc_id % 2 == 0} == {0}
    assert toxicity.toxicity(docs.where("false"), lab).count() == 0
    assert all(0 <= r.score <= 1 for r in got)


def test_channel_survives_pickling(channel):
    import pickle

    other = pickle.loads(pickle.dumps(channel))
    assert len(pickle.dumps(channel)) < 2_200_000 and other.restore("and 1d10t of") == "and idiot of" and other.log == channel.log
