"""Quality, mixing, chat formatting, HTML extraction, toxicity and the pipeline."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, html, mixing, quality, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, g string, x0 string, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS).repartition(3)


# --- quality ---


def plain_statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    r = random.Random(1)
    rows = []
    for i in range(700):
        n = r.randrange(40, 120)
        rows.append((i, " ".join("w" * r.randrange(2, 8) + str(r.randrange(500)) for _ in range(n)), "en", "s0" if i % 3 else "s1"))
    bad = [(1000 + i, " ".join(f"w{r.randrange(500)}" + "#%&*"[i % 4] * 3 for _ in range(60)), "en", "s0") for i in range(8)]
    rows += bad + [(2000, None, "en", "s0"), (2001, "", None, None), (2002, "a b c d e " * 30, "en", None), (2003, "a\n \na\nb\na\tb\x0bc", "xx", "s"), (2004, "é 😀 " * 20000, "en", "s0"), rows[0]]
    got = quality.judge_quality(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for x in got:
        want = plain_statistics(text[x["doc_id"]])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        assert x["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (x["kept"] and x["base_failed"])
    verdict = {x["doc_id"]: x["kept"] for x in got}
    assert not any(verdict[b[0]] for b in bad)
    assert sum(verdict[i] for i in range(700)) >= 695
    assert quality.judge_quality(frame(spark, [])).count() == 0


# --- mixing ---


def plain_shares(leaves, budget, epochs, weights):
    """Fills siblings by their weights, top down, one after another until none is over its capacity."""
    def pour(total, nodes):
        nodes, share, open_ = dict(nodes), {}, dict(nodes)
        left = total
        while open_:
            ws = sum(w for w, _ in open_.values())
            full = {k for k, (w, cap) in open_.items() if cap <= left * w / ws}
            if not full:
                for k, (w, cap) in open_.items():
                    share[k] = min(cap, int(left * w // ws))
                break
            k = min(full, key=lambda k: (open_[k][1] / open_[k][0], k))
            share[k] = open_[k][1]
            left -= share[k]
            del open_[k]
        return share

    weight = lambda level, name: weights[level].get(name, 1)
    cap = lambda keep: sum(t for leaf, t in leaves.items() if keep(leaf)) * epochs
    total = min(budget, cap(lambda leaf: True))
    out = {}
    top = pour(total, {d: (weight(0, d), cap(lambda x, d=d: x[0] == d)) for d in {x[0] for x in leaves}})
    for d, b in top.items():
        langs = pour(b, {g: (weight(1, g), cap(lambda x, d=d, g=g: x[:2] == (d, g))) for g in {x[1] for x in leaves if x[0] == d}})
        for g, c in langs.items():
            for s, v in pour(c, {s: (weight(2, s), leaves[d, g, s] * epochs) for s in {x[2] for x in leaves if x[:2] == (d, g)}}).items():
                out[d, g, s] = v
    return out


@pytest.mark.parametrize("share", [0.0, 0.3, 1.2, 5.0])
def test_mixing(spark, share):
    r = random.Random(7)
    rows = [(i, "w " * r.randrange(0, 60), r.choice(["en", "de", None]), r.choice(["src0"] * 4 + ["a", "b"])) for i in range(400)]
    rows += [(500, None, "en", "a"), (501, "", "en", "b"), rows[5]]
    weights = [{"crawl": 1, "curated": 3}, {"en": 2}, {}]
    got = mixing.mix_sources(frame(spark, rows), budget_share=share, epochs=2, weights=weights, domain=queries.mix_domain(), seed=3).collect()
    leaf = lambda r: ("crawl" if r[3] == "src0" else "curated", r[2] or "null", r[3])
    tokens = [len((r[1] or "").split()) for r in rows]
    leaves = {}
    for x, n in zip(rows, tokens, strict=True):
        leaves[leaf(x)] = leaves.get(leaf(x), 0) + n
    budget = int(sum(tokens) * share)
    shares = plain_shares(leaves, budget, 2, weights)
    want = []
    for name, total in shares.items():
        here = [(x, n) for x, n in zip(rows, tokens, strict=True) if leaf(x) == name]
        whole = total // leaves[name] if leaves[name] else 0
        part = total - whole * leaves[name]
        place = lambda i, whole=whole: int(hashlib.md5(f"{3 + whole}:{i}".encode()).hexdigest()[:15], 16)
        for x, n in here:
            upto = sum(m for y, m in here if place(y[0]) <= place(x[0]))
            if whole + (upto <= part) > 0:
                want.append((x[0], n, whole + (upto <= part), name[0]))
    assert sorted((x["doc_id"], x["n_tokens"], x["copies"], x["domain"]) for x in got) == sorted(want)
    assert sum(n * c for _, n, c, _ in want) <= min(budget, 2 * sum(tokens))


def test_mixing_empty(spark):
    assert mixing.mix_sources(frame(spark, [])).count() == 0


# --- chat ---


def test_chat(spark):
    rows = [(1, 2, "assistant", " b \n\n"), (1, 1, "user", "a <|im_end|> <\\| <\\\\|x"), (2, 1, "assistant", "<|im_start|>" * 3 + "é😀\n<|endoftext|>"), (2, 2, None, None), (2, None, "system", ""), (3, 1, "user", "only"), (None, 1, "assistant", "z" * 50000), (1, 2, "assistant", " b \n\n"), (4, 1, "<|im_sep|>", "<"), (4, 2, "assistant", "<"), (4, 3, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(3)
    with open("/opt/tokenizers/byte_bpe_50k.json", encoding="utf-8") as f:
        got = {r["conv_id"]: r for r in chat.format_conversations(df, f.read()).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert chat.read_turns(r["formatted"]) == [t[2:] for t in turns]
        assert r["n_turns"] == len(turns)
        under = [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
        assert under == [t[3] for t in turns if t[2] == "assistant" and t[3]]
        assert all(0 <= t["first"] < t["last"] <= r["n_tokens"] for t in r["loss_tokens"])
        assert r["formatted"].count(chat.START) == len(turns)


def test_chat_query_reads_back(spark, sf):
    got = {r["conv_id"]: r for r in queries.op6_chat_format(spark, sf).collect()}
    text = "<|im_end|><|im_start|>assistant ok"
    x = got[-1]
    assert x["n_turns"] == 2 and x["loss_chars"] == len(text)
    assert x["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert x["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    rows = duckdb.execute(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet' ORDER BY 1, 2").fetchall()
    for conv in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == conv]
        loss = "".join(r[3] or "" for r in here if r[2] == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in here).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(here), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_escapes_round_trip():
    from hypothesis import given
    from hypothesis import strategies as st

    @given(st.text(alphabet="<|\\im_endsarp> a"))
    def check(t):
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)

    check()


# --- html ---


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav>n</nav><article><h1>T &amp; U</h1><p>a\n  b<br>c<p>d &lt;x&gt;</article><footer>f</footer></body></html>", "T & U\na b c\nd <x>"),
        ("<article><header><h1>T</h1></header><p>a<aside>no</aside><script>if (a < b) x('</p>')</script><p>b</article>", "T\na\nb"),
        ("<article><p>a</p><div class='comments'><p>no</p></div><form><p>no</p></form><p class=\"cookie-notice\">no</p>b</article>", "a\nb"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>cut</p><p", "cut"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
        ("<body><header>h</header><div id=content><p>x<p>y</div><div class='sidebar'>s</div></body>", "x\ny"),
        ("just text &#233; 1 < 2", "just text é 1 < 2"),
        ("<article><div hidden>h</div><!-- c --><p title='a>b'>x</p></article>", "x"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_extract(source, want):
    assert html.extract(source, None) == want


def test_articles_in_remarks_and_prose_beside_articles():
    remark = '<div class="comments"><article><p>no</p></article></div>'
    assert html.extract(f"<article><p>a</p>{remark}</article>", None) == "a" and html.extract(f"<main><article><p>a</p></article>{remark}</main>", None) == "a"
    assert html.extract("<main><article><p>a</p></article><p>b</p></main>", None) == "a\nb"
    assert html.extract("<main><article><p>a</p></article><div><p><a href=x>more</a></p></div></main>", None) == "a"
    assert html.extract('<body class="comments"><article><p>a</p></article></body>', None) == "a" and html.extract('<div class="comments"><article><p>a</p></article></div>', None) == "a"


def test_templates_alone_take_menus_out_of_the_given_pages(spark):
    """Counted plainly by host; Spark takes the same subtrees out, and menus go on most pages before any mark is read."""
    import re
    from collections import Counter, defaultdict

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    host = lambda u: (re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]+)", u or "") or [None, ""])[1].lower()
    size = Counter(host(r["url"]) for r in rows)
    held = Counter((host(r["url"]), k) for r in rows for k in html.template_keys(r["html"]))
    known = defaultdict(list)
    for (h, k), n in held.items():
        if h and n >= html.MIN_PAGES and n >= html.MIN_SHARE * size[h]:
            known[h].append(k)
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages).collect()}
    assert got == {r["page_id"]: html.extract(r["html"], known.get(host(r["url"]))) for r in rows}
    many = [r for r in rows if size[host(r["url"])] >= 2 * html.MIN_PAGES]
    changed = [r for r in many if html.extract(r["html"], known[host(r["url"])], marks=False) != html.extract(r["html"], None, marks=False)]
    assert not many or len(changed) > 0.8 * len(many)
    menu = "<body><nav class='m{0}'><ul><li><a>x{0}</a></li><li><a>y{0}</a></li></ul></nav><div><p>Prose {0} without <a>link</a></p></div></body>"
    keys = set.intersection(*(set(html.template_keys(menu.format(i))) for i in range(5)))
    assert html.extract(menu.format(9), sorted(keys), marks=False) == "Prose 9 without link"


def test_site_templates(spark):
    page = lambda i: f"<body><div class='x'><p>Same on all pages of this site {i % 2}</p></div><div><p>Text {i}</p></div></body>"
    rows = [(i, f"https://H.example.com/{i}", page(i)) for i in range(12)] + [(20, "http://other.example.com/", page(0)), (21, None, page(0)), (22, "http://h.example.com/", None)]
    article = "<article><p>A passage that articles share</p><p>{}</p></article>"
    rows += [(30 + i, "http://articles.example.com/", article.format(i)) for i in range(10)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html.extract_text(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"Text {i}" for i in range(12))
    assert got[20] == got[21] == "Same on all pages of this site 0\nText 0" and got[22] == ""
    assert got[30] == "A passage that articles share\n0"
    assert html.extract_text(df.limit(0)).count() == 0


# --- toxicity ---


def test_toxicity_held_out(spark):
    out = queries.op3_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    pos, neg = [r[0] for r in rows if r[1]], [r[0] for r in rows if not r[1]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert auc > 0.85 and all(0 <= r[0] <= 1 and r[2] == (r[0] >= 0.5) for r in rows)
    assert out.count() == 1000


def test_toxicity_edges(spark):
    empty = toxicity.fit(spark.createDataFrame([], "text string, label int"))
    df = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (3, "a" * 200000, "old")], "doc_id long, text string, score string")
    assert [r["score"] for r in empty.score(df).collect()] == [0.0] * 3
    rows = [(f"word{i % 7} you idiot thing{i}", 1) for i in range(40)] + [(f"word{i % 7} you friend thing{i}", 0) for i in range(80)] + [(None, 0), ("", 0), ("x", None)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    got = {r["doc_id"]: r["score"] for r in model.score(df.union(spark.createDataFrame([(4, "you are an idiot", "o"), (5, "a friend", "o")], df.schema))).collect()}
    assert len(got) == 5 and got[4] > 0.5 > got[5] and got[1] == got[2] < 0.5


# --- pipeline ---


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        assert docs.count() <= before
        before = docs.count()
        assert docs.columns[: len(columns)] == columns if k == 4 else docs.columns == columns
    assert 0 < before
    again = corpus_pipeline.run(spark, sf)
    assert sorted(r[0] for r in again.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


# --- later rules ---


def test_html_depth_classes_and_whole_page_templates():
    deep = "<div>" * 400 + "<nav>MENU</nav>x" + "</div>" * 400
    assert html.extract(deep, None) == "x" and html.extract("<nav>" * 5000 + "a", None) == ""
    assert html.extract("<article class='entry-header'><h1>T</h1><p>b</p></article>", None) == "T\nb"
    assert html.extract("<article><div class='post-header'><h1>T</h1></div><section class='related-work'>w</section><p class='skip-a'>s</p></article>", None) == "T\nw\ns"
    assert html.extract("<article><p>a</p><div class='related-posts'>no</div><div id='comment-list'>no</div></article>", None) == "a"
    page = "<body><table><tr><td>Home</td></tr></table><article><div><p>Sign up here</p></div><p>own {}</p></article><p>Imprint</p></body>"
    pages = [page.format(i) for i in range(6)]
    keys = set.intersection(*(set(html.template_keys(p)) for p in pages))
    assert html.extract(pages[3], sorted(keys), marks=False) == "own 3"  # the templates alone leave the article


def test_quality_verdicts_are_those_of_a_plain_estimate(spark):
    """The least determinant of many random starts in numpy gives the same verdicts."""
    import numpy as np

    r = random.Random(6)
    texts = [" ".join("w" * r.randrange(2, 8) + str(r.randrange(900)) + ("%" if r.random() < 0.02 else "") for _ in range(r.randrange(30, 160))) for _ in range(400)]
    texts += [" ".join(f"w{r.randrange(900)}" + "#%"[i % 2] * 4 for _ in range(70)) for i in range(12)] + [" ".join("x" * 60 + str(r.randrange(900)) for _ in range(60)) for _ in range(6)]
    got = {x["doc_id"]: x["kept"] for x in quality.judge_quality(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    s = np.array([plain_statistics(t) for t in texts], dtype=float)
    n = s[:, 0] + 1
    x = np.stack([np.log1p(s[:, 0]), np.log((s[:, 1] + 1) / n), np.log1p(1000 * s[:, 2] / (s[:, 1] + 1)), np.log1p(1000 * s[:, 3] / n), np.log1p(1000 * s[:, 4] / n)], axis=1)
    g, best = np.random.default_rng(1), (np.inf, None)
    h, target = int(np.ceil(quality.INNER * len(x))), np.diag(np.square(quality.TARGETS))

    def fit(rows):
        mean = rows.mean(axis=0)
        return mean, np.cov(rows.T, bias=True) + target

    def distances(f):
        d = x - f[0]
        return (d @ np.linalg.inv(f[1]) * d).sum(axis=1)

    for _ in range(30):
        f, last = fit(x[g.choice(len(x), 20, replace=False)]), np.inf
        while True:
            f = fit(x[np.argsort(distances(f), kind="stable")[:h]])
            now = np.linalg.slogdet(f[1])[1]
            if last - now <= 1e-9:
                break
            last = now
        if now < best[0]:
            best = (now, distances(f))
    d = best[1] / max(1.0, float(np.median(best[1])) / quality.MEDIAN_CHI2)
    clear = [i for i in range(len(texts)) if abs(d[i] - quality.CUTOFF) > 2]
    assert len(clear) > 410 and all(got[i] == (d[i] <= quality.CUTOFF) for i in clear) and not all(got.values())
