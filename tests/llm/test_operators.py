"""The training-data operators against plain versions, on small fixtures with nulls, empties, ties and repeated rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparkloom.llm import components, crf, decontaminate, fingerprint, html_extract, huffman, language_id, mixing, near_dedup, quality, token_output, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=True):
    """(doc_id, text, lang, source) rows, with columns whose names operators use inside."""
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)
    return df.selectExpr("*", "'x' as score", "1 as size", "2 as component", "3 as at", "4 as range", "5 as kept", "6 as id", "7 as key", "8 as _id", "9 as _size", "10 as _copies", "11 as _src", "'z' as lang_pred", "map('a', 1) as tags", "12 as copy", "13 as item_id") if extra else df


WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "n r s t l".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        rows.append((i, prose(rng, rng.randint(1, 60)), rng.choice(["en", "de"]), rng.choice(["a", "b", None, "c"])))
    base = prose(rng, 80).split()
    for i in range(60, 90):  # a family of near copies
        w = list(base)
        w[rng.randrange(80)] = "odd"
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(90, None, None, None), (91, "", "en", "b"), (92, "  \n ", "en", "b"), (93, "one", "en", "b"), (94, "ONE", "en", "c"), (95, rows[3][1], "en", "c"), (96, "x " * 3000, "en", "c")]
    rows.append(rows[4])  # a repeated row
    return rows


# Conditional random field


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 5, 64, 65, 200, 0, 700])
    emit, trans, start = rng.normal(size=(lengths.sum(), 3)) * 3, rng.normal(size=(3, 3)), rng.normal(size=3)
    got, fwd, eb = crf.forward_backward(emit, lengths, trans, start)
    at, pairs = 0, np.zeros((3, 3))
    for n in lengths[lengths > 0]:
        e, t = np.exp(emit[at : at + n]), np.exp(trans)
        a, b = np.zeros((n, 3)), np.ones((n, 3))
        a[0] = np.exp(start) * e[0]
        for i in range(1, n):
            a[i - 1] /= a[i - 1].sum()
            a[i] = (a[i - 1] @ t) * e[i]
        for i in range(n - 2, -1, -1):
            b[i] = t @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        p = a * b
        assert np.allclose(p / p.sum(axis=1, keepdims=True), got[at : at + n])
        for i in range(n - 1):
            x = a[i][:, None] * t * (e[i + 1] * b[i + 1])[None]
            pairs += x / x.sum()
        at += n
    assert np.allclose(pairs, crf.pair_marginals(fwd, eb, lengths, trans))


def test_crf_learns_transitions():
    f = lambda w: [1 + ord(w[0]) % 7]
    data = [(["a", "b", "c"] * 5, [0, 0, 1] * 5), (["b", "c", "a"] * 5, [0, 1, 0] * 5)]
    m = crf.CRF(["x", "y"], 16, f).fit(data, rounds=60)
    assert (m.marginals(["a", "b", "c"], np.array([3])).argmax(axis=1) == [0, 0, 1]).all()


def test_toxicity(spark):
    rng = random.Random(3)
    bad = ["skunkhead", "ratface", "dungbag"]
    rows, labels = [], []
    for i in range(200):
        words = prose(rng, 30).split()
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, toxic))
    rows += [(200, None, None, None), (201, "", None, None), (202, "x " * 5000 + "You Ratface!", "en", "a"), rows[1]]
    df = documents(spark, rows)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["predicted"] == t for i, _, t in labels)
    assert by[200]["predicted"] == by[201]["predicted"] == 0 and by[200]["spans"] == []
    text = rows[202][1]
    assert [text[s["start"] : s["end"]] for s in by[202]["spans"]] == ["Ratface!"]
    assert by[7]["held_out"] == (zlib.crc32(b"7") % 5 == 0)
    none = toxicity.toxicity(df.limit(0), lab)
    assert none.count() == 0


def test_language(spark):
    rng = random.Random(4)
    make = lambda ends, n: " ".join(rng.choice(WORDS) + rng.choice(ends) for _ in range(n))
    langs = {"de": ["ung", "heit", "en"], "fr": ["eux", "tion", "é"], "pt": ["ção", "os", "inho"]}
    rows = [(i, make(langs[k], 25), k, "a") for i, k in enumerate(list(langs) * 40)]
    rows += [(500, None, "de", None), (501, "123 ...", "de", None), (502, make(langs["pt"], 6000), None, None), rows[0]]
    got = language_id.language_id(documents(spark, rows)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(by[i]["lang_pred"] == k for i, _, k, _ in rows[:120])
    assert by[500]["lang_pred"] == by[501]["lang_pred"] == "und" and by[502]["lang_pred"] == "pt"
    assert language_id.language_id(documents(spark, [(1, "abc", None, None)])).first()["lang_pred"] == "und"


def test_code_switching():
    rng = random.Random(4)
    make = lambda ends, n: " ".join(rng.choice(WORDS) + rng.choice(ends) for _ in range(n))
    a, b = ["ung", "heit", "en"], ["eux", "tion", "é"]
    m = language_id.fit([make(a, 40) for _ in range(30)] + [make(b, 40) for _ in range(30)], ["de"] * 30 + ["fr"] * 30)
    words = (make(a, 20) + " " + make(b, 20)).split()
    assert (m.marginals(words, np.array([40])).argmax(axis=1) == [0] * 20 + [1] * 20).mean() > 0.95


# HTML


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<b>b</b>c <i>d</i></p><p>x&nbsp;&nbsp;y", "abc d\nx y"),
        ("<div><p>foo <script>if (a<b) x('</p>')</script>bar</p></div>", "foo bar"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<html><head><title>t</title></head><body><header>Site</header><nav><a>x</a></nav><article><h1>T</h1><p><b>One, two. Three.<br><p>Four.</article><footer>f</footer>", "T\nOne, two. Three.\nFour."),
        ("<body><div class='menu'>a b c</div><div id=main><h2>Title</h2><p>One two three, four. Five six.</p><p>Short</p><div class='cookie-notice'>Cookies, ok.</div><ul><li>x one<li>y</ul><form>Name <input></form></div><div id=comments><p>Great, really great, I say.</p></div><aside>side</aside></body>", "Title\nOne two three, four. Five six.\nShort\nx one\ny"),
        ("<article><p>Some words, here.</p><!-- cut off", "Some words, here."),
        ("<body><div class=\"wrap has-sidebar\"><nav>x</nav><p>Hello, you. There.</p><p>b</p></div></body>", "Hello, you. There.\nb"),
    ],
)
def test_html(html, text):
    assert html_extract.extract(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><h1>Site</h1><div class='wrap has-sidebar'><article><p>One two, three. Four five, six.</p></article><div class='sidebar'>Links</div></div></body>", "One two, three. Four five, six."),
        ("<body><p>Site</p><div class='no-comments'><p>One two, three. Four five, six.</p><p>Seven eight, nine.</p></div></body>", "One two, three. Four five, six.\nSeven eight, nine."),
        ("<body><p>Site</p><form><div><p>One two, three. Four five, six.</p><label>Name</label></div></form></body>", "One two, three. Four five, six."),
        ("<body><p>Hi</p><div class='widget'><p>One two, three. Four five, six.</p></div><div class='widget'><p>Seven, eight, nine. Ten eleven.</p></div></body>", "Hi\nOne two, three. Four five, six.\nSeven, eight, nine. Ten eleven."),
        ("<body><h1>Site</h1><article><p>One two, three. Four five.</p></article><section><p>Six seven, eight. Nine, ten.</p></section><ul><li>a<li>b</ul></body>", "One two, three. Four five.\nSix seven, eight. Nine, ten.\na\nb"),
        ("<body><article><p>One two, three. Four five, six.</p></article><aside><article><p>Card, other.</p></article></aside><div class='comments'><p>Great, really great, I say. Yes, yes.</p></div></body>", "One two, three. Four five, six."),
    ],
)
def test_html_words_give_way_to_content(html, text):
    got = html_extract.extract(html).split("\n")
    assert got in (text.split("\n"), ["Site", *text.split("\n")])


@pytest.mark.parametrize("html", ['<a "' * 25_000, "<a " * 30_000, '<a x="' * 20_000, "<a x='" * 20_000 + '"', "<div>" * 20_000 + "</b>" * 20_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000, "<b>" * 20_000 + "<p>x" * 5_000, "<!--" * 20_000, "<" * 100_000, "&" * 100_000])
def test_broken_markup_takes_linear_time(html):
    import time

    began = time.process_time()
    html_extract.extract(html)
    assert time.process_time() - began < 5  # quadratic work on 100 KB takes minutes


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p class=it's>Hello</p>", "Hello"),
        ("<p data-x='un closed>Lost text", "Lost text"),
        ("<p title='a > b' class=\"x\">c</p>", "c"),
        ("<main><article><p>One, two three. Four.</p></article><article><p>Five, six seven. Eight.</p></article></main>", "One, two three. Four.\nFive, six seven. Eight."),
        ("<body><p>tiny</p><div class='post-share-story'><p>Prose one, two. Three four five six.</p><p>More prose, here. And so on.</p></div></body>", "Prose one, two. Three four five six.\nMore prose, here. And so on."),
        ("<article><p>E = <math><mi>m</mi><mi>c</mi></math>, done.</p></article>", "E = mc, done."),
        ("<p>a < b, x <3 y</p>", "a < b, x <3 y"),
        ("<div data-class='menu'>text here</div>", "text here"),
    ],
)
def test_html_odd_markup(html, text):
    assert html_extract.extract(html) == text


def test_html_scores_decide(monkeypatch):
    page = "<body><div class='nav'>Home, about. Links</div><div><p>One two three, four. Five six, seven.</p><p>Eight, nine ten.</p></div><div class='sidebar'><p>Other, things.</p></div></body>"
    assert html_extract.extract(page) == "One two three, four. Five six, seven.\nEight, nine ten."
    monkeypatch.setattr(html_extract, "path_scores", lambda blocks: {(x.path, x.boiler): 1.0 for x, _ in blocks})
    assert "Other, things." in html_extract.extract(page)


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    got = html_extract.extract_pages(df).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == [(1, "a", 1), (2, "", 0), (2, "", 0)]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


# Near duplicates


def brute_components(rows, width, percent=80):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), len(sets[i])) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, corpus, width):
    got = near_dedup.near_duplicates(documents(spark, corpus), width, 80).collect()
    want = brute_components(corpus, width)
    assert len(got) == len(corpus)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("block", [3, 17])
def test_near_duplicates_in_cut_regions(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    for width in (2, 5):
        got = near_dedup.near_duplicates(documents(spark, corpus), width, 80).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {k: v[0] for k, v in brute_components(corpus, width).items()}


@pytest.mark.parametrize("percent, differ, block", [(80, 10, 2000), (80, 10, 2), (50, 30, 2000), (95, 2, 2000)])
def test_pairs_at_the_limit_are_found(spark, monkeypatch, percent, differ, block):
    # Six hundred pairs just over the similarity asked, which nothing else links.
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(11)
    rows = []
    for k in range(600):
        words = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        other = [w + "x" if j < differ else w for j, w in enumerate(words)]
        rows += [(2 * k, " ".join(words), "en", "a"), (2 * k + 1, " ".join(other), "en", "a")]
    got = near_dedup.near_duplicates(documents(spark, rows), 1, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i // 2 * 2 for i in range(1200)}


def test_families_of_edited_copies(spark):
    # Copies with one to thirty of 120 words changed: some link to each other, some to nothing.
    rng = random.Random(17)
    rows = []
    for f in range(3):
        base = prose(rng, 120).split()
        for _ in range(90):
            words = list(base)
            for j in rng.sample(range(120), rng.randint(1, 30)):
                words[j] = rng.choice(WORDS) + rng.choice(WORDS)
            rows.append((len(rows), " ".join(words), "en", "a"))
    for width, percent in ((1, 80), (2, 80), (2, 60)):
        got = near_dedup.near_duplicates(documents(spark, rows), width, percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {k: v[0] for k, v in brute_components(rows, width, percent).items()}


def test_sketches_reject_no_pair():
    rng = np.random.default_rng(4)
    for n in (5, 300, 1000, 1100, 4000, 9000):
        sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(40)]
        most = int(n * 2 * 20 / 180)  # shingles that may differ at 0.8
        pairs = [(s, np.unique(np.concatenate([s[most - most // 2 :], rng.integers(0, 1 << 63, max(0, most // 2 - 1)).astype(np.uint64)]))) for s in sets]
        pairs += [(s, s[: max(1, -(-8 * len(s) // 10))]) for s in sets]
        flat = [x for p in pairs for x in p]
        table = {"p": np.repeat(np.arange(len(pairs)), 2), "block": np.zeros(len(flat), int), "id": np.arange(len(flat)), "c": np.arange(len(flat)), "n": [len(x) for x in flat], "v": [len(x) for x in flat], "odd": [near_dedup.sketch(x) for x in flat]}
        import pyarrow as pa

        own = near_dedup._Rows(pa.table(table), 80)
        even = np.arange(0, len(flat), 2)
        assert (own.ratio(even, even + 1) <= 1).all()
        assert (own.ratio(even[:-1], even[1:]) > 1).all() or n < 10


def test_layout_keeps_recall():
    for percent in (30, 50, 80, 95):
        trees, base = near_dedup.layout(percent)
        assert trees * base <= near_dedup.HASHES and (1 - (percent / 100) ** base) ** trees <= near_dedup.MISS
    assert near_dedup.layout(80) == (32, 4)


def test_repeated_ids_with_different_texts(spark, corpus):
    rows = [(1, "a b c d e f", "en", "a"), (1, "q r s t u v", "en", "a"), (2, "q r s t u v", "en", "a"), (3, "a b c d e f", "en", "a"), (4, "z", "en", "a")]
    seen = {tuple(sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(documents(spark, rows).repartition(k), 2, 80).collect())) for k in (1, 3, 4)}
    assert seen == {((1, 1), (1, 1), (2, 1), (3, 1), (4, 4))}


def test_deduplicate_and_empty_table(spark, corpus):
    df = documents(spark, corpus)
    kept = near_dedup.deduplicate(df, 5, 80)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({v[0] for v in brute_components(corpus, 5).values()})
    assert near_dedup.near_duplicates(df.limit(0), 2, 80).count() == 0
    odd = documents(spark, [(None, "a b c", None, None), (None, None, None, None), (7, "a b c", None, None)])
    assert sorted((r["doc_id"] is None, r["kept"]) for r in near_dedup.near_duplicates(odd, 2, 80).collect()) == [(False, True), (True, True), (True, True)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {a: find(a) for a in list(parent) if find(a) != a}
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {r["node"]: r["component"] for r in got} == want


# Mixing


def test_mixing(spark, corpus):
    rows = corpus[:-1]
    got = mixing.schedule(documents(spark, rows), [5, 2, 1]).collect()
    sizes, order = defaultdict(int), {}
    for _, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        order[s] = [5, 2, 1][k % 3]
    targets, open_, left = {}, dict(order), 1.5 * sum(sizes.values())
    while open_:  # share by weight until no source is above twice its size
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > 2 * sizes[s]]
        if not over:
            targets |= share
            break
        for s in over:
            targets[s] = 2.0 * sizes[s]
            left -= targets[s]
            del open_[s]
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    longest = max(r["size"] for r in got)
    assert all(abs(taken[s] - targets[s]) <= 2 * longest for s in targets)
    again = mixing.schedule(documents(spark, rows).repartition(7), [5, 2, 1]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_repeats_rows(spark, corpus):
    df = documents(spark, corpus[:60])
    plan = {r["doc_id"]: r["copies"] for r in mixing.schedule(df, [5, 2, 1]).collect()}
    mixed = mixing.mix(df, [5, 2, 1])
    assert mixed.columns == df.columns
    count = defaultdict(int)
    for r in mixed.collect():
        count[r["doc_id"]] += 1
    assert {k: v for k, v in plan.items() if v} == dict(count)
    assert mixing.schedule(df.limit(0), [5, 2, 1]).count() == 0
    assert mixing.schedule(documents(spark, [(1, None, None, None)]), [1]).first()["taken"] == 0


# Token ids


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_huffman_round_trip():
    rng = np.random.default_rng(2)
    for n, vocabulary in ((0, 4), (1, 4), (255, 3), (257, 9), (70_000, 5000)):
        ids = (rng.zipf(1.3, n) - 1) % vocabulary
        counts = np.bincount(ids, minlength=vocabulary)
        lengths = huffman.code_lengths(counts, 13)
        assert lengths.max(initial=0) <= 13 and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
        book = huffman.Codebook(lengths)
        docs, per, back = huffman.unpack(book, huffman.pack(book, np.array([7]), np.array([n]), ids))
        assert (docs == [7]).all() and (per == [n]).all() and (back == ids).all()


def test_huffman_lengths_are_optimal():
    import heapq

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 100, 40)
    heap, cost = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert (huffman.code_lengths(counts, 20).astype(int) * counts).sum() == cost


def test_encoder_equals_whole_texts():
    e = token_output.Encoder(tokenizer(), 2, cache=50)
    odd = ["a  b", " a", "a\n\nb", "x\tb", "a <|endoftext|> b", "don't  'll", "é\u00a0b", "a\n b", "", None, "\n", "1 2'3 '", "it 's\u2028x", "y\n'z", "ÀÉ 12½ %%%"]
    got = e.encode(odd * 3)
    assert got == [w + e.end for w in e.whole([t or "" for t in odd])] * 3


def test_runs_equal_the_whole_tokenizer():
    e = token_output.Encoder(tokenizer(), 2)
    rng = random.Random(5)
    marks = [chr(c) for c in range(1, 0x260) if not chr(c).isspace()]
    runs = {x for c in marks for x in (c, " " + c, c * 3, " " + c * 2)}
    for kind in (str.isalpha, str.isnumeric, lambda c: not c.isalnum()):
        own = [c for c in marks if kind(c)]
        runs |= {rng.choice(("", " ")) + "".join(rng.choices(own, k=rng.randint(1, 9))) for _ in range(2000)}
    runs = [r for r in sorted(runs) if token_output._RUNS.findall(r) == [r] and "<|" not in r]
    assert len(runs) > 4000 and e._runs(runs) == e.whole(runs)


def test_token_output(spark, corpus):
    from tokenizers import Tokenizer

    rows = corpus[:60] + corpus[90:96] + [(None, "null id", None, None)]
    got = token_output.encode_and_read_back(documents(spark, rows).repartition(5), tokenizer()).collect()
    t, start, want = Tokenizer.from_file(tokenizer()), 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_output.encode_and_read_back(documents(spark, rows).limit(0), tokenizer()).count() == 0


# Fingerprints


def test_fingerprints(spark, corpus):
    rows = corpus[:96] + [(200, "Ｆｕｌｌ  Width", None, None), (201, "full\twidth ", None, None)]
    got = {r["doc_id"]: r for r in fingerprint.edit_likeness(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        assert got[i]["near_next"] == float(fingerprint.canonical(text) == fingerprint.canonical(after))
        assert got[i]["near_edited"] == float(got[i]["fingerprint"] == got[i]["edited_fingerprint"])
    assert got[200]["fingerprint"] == got[201]["fingerprint"] and got[95]["fingerprint"] == got[3]["fingerprint"]
    assert fingerprint.edit_likeness(documents(spark, rows).limit(0)).count() == 0


def test_fingerprints_over_many_ranges(spark):
    rows = [(i * 3, f"text {i}", None, None) for i in range(50)]
    seen = {}

    def note(batch):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in batch]), pa.array([r[2] for r in batch])], names=["doc_id", "after"])

    for r in fingerprint.with_next(documents(spark, rows), note, "doc_id long, after string", rows=4).collect():
        seen[r["doc_id"]] = r["after"]
    assert seen == {i * 3: f"text {(i - 1) % 50}" for i in range(50)}


def test_next_documents_with_repeated_and_null_ids(spark):
    import pyarrow as pa

    rows = [(None, "none", None, None), *[(7, f"same {i % 2}", None, None) for i in range(9)], *[(i, f"text {i}", None, None) for i in range(20, 40)], (1, None, None, None)]
    note = lambda batch: pa.RecordBatch.from_arrays([pa.array([r[k] for r in batch], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["doc_id", "text", "after"])
    low = fingerprint.NO_ID
    order = sorted(((low if i is None else i, t or "") for i, t, *_ in rows), key=lambda r: (-r[0], r[1]))
    want = sorted((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order))
    for size in (1, 3, 1000):
        assert sorted(map(tuple, fingerprint.with_next(documents(spark, rows), note, "doc_id long, text string, after string", rows=size).collect())) == want
    one = fingerprint.with_next(documents(spark, rows[:1]), note, "doc_id long, text string, after string").collect()
    assert [tuple(r) for r in one] == [(low, "none", "none")]


def test_colliding_digests_are_found(spark, monkeypatch):
    df = documents(spark, [(1, "a", None, None), (2, "b", None, None), (3, "a", None, None)])
    found = spark.createDataFrame([(1, "k"), (2, "k"), (3, "k")], "doc_id long, fingerprint string")
    assert fingerprint.collisions(df, found).count() == 0  # digests differ, whatever the table says
    assert fingerprint.canonical("Straße ﬁ") == "strasse fi".encode()


# Decontamination


def test_decontamination(spark):
    items = [(1, "How many kilometers does Anna travel in 45 minutes if the train moves at 80 km per hour today"), (2, "too short item"), (3, "The old lamp burned through the quiet night while seven birds slept above the narrow door")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "Noise before. " + items[0][1] + " and noise after", None, None),
        (2, "So how many kilometers does Boris travel in 30 minutes if the train moves at 120 km per hour today ok", None, None),
        (3, "A clean text that shares nothing with any of the items above at all", None, None),
        (4, items[2][1].upper(), None, None),
        (5, None, None, None),
        (6, "", None, None),
        (7, "too short item", None, None),
        (7, "too short item", None, None),
    ]
    got = decontaminate.contaminated(documents(spark, rows), bench).collect()
    assert sorted((r["doc_id"], tuple(r["items"])) for r in got) == [(1, (1,)), (2, (1,)), (3, ()), (4, (3,)), (5, ()), (6, ()), (7, ()), (7, ())]
    kept = decontaminate.decontaminate(documents(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 7, 7]
    assert decontaminate.contaminated(documents(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contaminated(documents(spark, rows).limit(0), bench).count() == 0


def test_null_and_repeated_item_ids(spark):
    long = "the old lamp burned through the quiet night while seven birds slept above the narrow door and nobody in the whole street saw them leave"
    other = "a runner covers 5 km before breakfast and another 8 km after lunch so how far did she run"
    short = "who wrote the red book"
    bench = spark.createDataFrame([(None, long), (1, other), (1, short), (1, long + " again that day"), (2, other), (2, other), (3, None)], "item_id long, text string")
    rows = [(1, long, None, None), (2, "So: " + other + ", please", None, None), (3, short, None, None), (4, "nothing of all that is in this text here", None, None)]
    got = {r["doc_id"]: (r["contaminated"], r["items"], round(r["coverage"], 6)) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert got == {1: (True, [1], 1.0), 2: (True, [1, 2], 1.0), 3: (True, [1], 1.0), 4: (False, [], 0.0)}
    assert [r["doc_id"] for r in decontaminate.decontaminate(documents(spark, rows), bench).collect()] == [4]
    only = bench.where("item_id is null")
    got = {r["doc_id"]: (r["contaminated"], r["items"]) for r in decontaminate.contaminated(documents(spark, rows), only).collect()}
    assert got == {1: (True, []), 2: (False, []), 3: (False, []), 4: (False, [])}


def test_inconsistent_slots_do_not_match(spark):
    text = "if 5 apples cost 5 coins and each of the 5 children buys some apples then who pays the bill"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    rows = [(1, text.replace("5", "8"), None, None), (2, text.replace("5", "8", 1).replace("5", "9"), None, None)]
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert got == {1: True, 2: False}


def test_changed_and_glued_units_match(spark):
    text = "a runner covers 5 km before breakfast and another 8 km after lunch so how far did she run"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    copies = [text, text.replace("km", "miles"), text.replace(" km", "km"), text.replace(" km", "miles"), text.replace("km", " KM"), text.replace(" km", "%")]
    got = {r["doc_id"]: (r["contaminated"], r["coverage"]) for r in decontaminate.contaminated(documents(spark, [(i, c, None, None) for i, c in enumerate(copies)]), bench).collect()}
    assert got == {i: (True, 1.0) for i in range(len(copies))}
    mixed = text.replace("5 km", "6 miles")  # one unit of the item can't stand for two
    assert decontaminate.contaminated(documents(spark, [(1, mixed, None, None)]), bench).where("contaminated").count() == 0


def test_slots_are_judged_by_occurrence(spark):
    text = "the farmer pays 3 coins for the red apples and his sister Anna later pays 5 coins for the red apples too"
    long = "if 5 workers paint the tall fence in one day then how many of them would be needed for the whole street"
    bench = spark.createDataFrame([(1, text), (2, long)], "item_id long, text string")
    other = text.replace("3", "7").replace("5", "9")
    again = long.replace("5", "8")
    rows = [
        (1, other, None, None),  # one window at two spots
        (2, again + " and so on " + long.replace("5", "12"), None, None),  # twice, with other numbers
        (3, again + " far away " + "x y " * 40 + "if 6 workers paint the old barn", None, None),  # a window by chance
        (4, again.replace("tall fence", "tall and wide fence") + " z " * 60 + long.replace("5", "9").replace("tall fence", "tall white fence"), None, None),  # twice, with words put in
        (None, again, None, None),
        (None, long.replace("5", "7"), None, None),
    ]
    got = [(r["doc_id"], r["items"]) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()]
    assert sorted(got, key=str) == sorted([(1, [1]), (2, [2]), (3, [2]), (4, [2]), (None, [2]), (None, [2])], key=str)


def test_passages_of_long_items_and_number_heavy_items(spark):
    rng = random.Random(3)
    long, sums = prose(rng, 500), "What is 12 + 7 * 3 - 4 / 2 ?"
    bench = spark.createDataFrame([(1, long), (2, sums), (3, prose(rng, 59))], "item_id long, text string")
    part = lambda i, n: " ".join(bench.where(f"item_id = {i}").first()["text"].split()[20 : 20 + n])
    texts = [part(1, 200), part(3, 30), part(1, 6), "Tell me. " + sums + " Quickly now", sums.replace("12", "13"), prose(rng, 300)]
    got = {r["doc_id"]: r["items"] for r in decontaminate.contaminated(documents(spark, [(i, x, None, None) for i, x in enumerate(texts)]), bench).collect()}
    assert got == {0: [1], 1: [3], 2: [], 3: [2], 4: [], 5: []}


def test_texts_are_judged_by_themselves(spark):
    item = "the farmer carries seven heavy baskets of ripe plums over the narrow bridge before the evening bell rings twice"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    words = item.split()
    halves = [" ".join(words[:8]), " ".join(words[8:])]
    rows = [(None, halves[0], None, None), (None, halves[1], None, None), (None, item, None, None), (3, item, None, None), (3, "quite another text", None, None)]
    got = sorted((r["doc_id"] is None, r["contaminated"]) for r in decontaminate.contaminated(documents(spark, rows), bench).collect())
    assert got == [(False, False), (False, True), (True, False), (True, False), (True, True)]
    assert sorted(r["text"] for r in decontaminate.decontaminate(documents(spark, rows), bench).collect()) == sorted([*halves, "quite another text"])


# The pipeline


def test_stages_on_odd_rows(spark, corpus, monkeypatch):
    import corpus_pipeline

    item = "the old lamp burned through the quiet night while seven birds slept above the narrow door of the mill"
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: spark.createDataFrame([(1, item)], "item_id long, text string"))
    rows = [*corpus, (None, None, None, None), (None, "a text without an id", None, None), (None, "a text without an id", None, None), (300, "before " + item, "en", "a")]
    for make in (lambda: rows, lambda: []):
        docs, held = documents(spark, make()), {r[0]: r[1] for r in make()}
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = stage(spark, before, "")
            if name == "token_output":
                break
            assert docs.columns == columns and [f.dataType for f in docs.schema.fields] == [f.dataType for f in before.schema.fields]
            left, kept = sorted(((r["doc_id"], r["text"]) for r in before.collect()), key=str), sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
            assert all(held.get(i) == t or i is None for i, t in kept)
            if name == "language_id":
                assert kept == [(i, t) for i, t in left if t and any(map(str.isalpha, t))]
            elif name == "near_dedup":
                least = {v[0] for v in brute_components([r for r in left if r[0] is not None], 5).values()}
                assert kept == sorted([*{(i, t) for i, t in left if i in least}, *[x for x in left if x[0] is None]], key=str)
            elif name == "decontamination":
                assert kept == [x for x in left if item not in x[1]]
            else:
                count = lambda xs: {x: xs.count(x) for x in xs}
                assert all(n <= 2 * left.count(x) for x, n in count(kept).items()) and set(kept) <= set(left) and bool(kept) == bool(left)
        want = sorted((i is not None, i or 0, t or "") for i, t in ((r["doc_id"], r["text"]) for r in before.collect()))
        got = sorted((r["start"], r["doc_id"]) for r in docs.collect())
        assert [i for _, i in got] == [i if known else None for known, i, _ in want]


# Quality


def test_quality_orders_grades(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        g = i % 3
        rows.append((i, " ".join(w.upper() + "!!" if rng.random() < g / 2 else w for w in prose(rng, 40).split()), "en", "a"))
        labels.append((i, 2 - g, 0))
    rows += [(900, None, None, None), (901, "", None, None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(documents(spark, rows), lab).collect()}
    assert np.mean([got[i]["predicted"] == g for i, g, _ in labels]) > 0.9
    assert all(a >= b for r in got.values() for a, b in zip(r["tails"], r["tails"][1:]))
    assert all(abs(sum(r["tails"]) - r["expected_grade"]) < 1e-9 for r in got.values()) and 900 in got and 901 in got
    flat = quality.quality(documents(spark, rows[:3]), lab.selectExpr("doc_id", "1 as quality", "0 as toxic"))
    assert {r["predicted"] for r in flat.collect()} == {1.0}


# URLs


def brute_rule(host, path, rules):
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(h), len(p)) > best[0]):
            best = ((len(h), len(p)), h + p, verdict)
    return (best[1], best[2]) if best else (None, "allow")


def test_url_filter(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    urls = ["http://WWW.Example.com/en/1?x", "https://a.example.com/en/", "ftp://x.com", "http://x.com/y#z", "http://b.net/es/q", "http://b.net/es", "nothing", None, "", "http://net/fr/", "x://y://z/p", "http://xexample.com/en/", "http://a.org/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule")
    for r in url_filter.filter_urls(df, rules).collect():
        url = urls[r["page_id"]]
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([k for k in (rest.find(c) for c in "/?#") if k >= 0] or [len(rest)])
            host, path = rest[:end].lower(), rest[end:]
            path = path[: min([k for k in (path.find(c) for c in "?#") if k >= 0] or [len(path)])]
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == brute_rule(host, path, rules)
    assert url_filter.filter_urls(df, []).where("rule is not null").count() == 0


def test_digest_array_confirms_strings(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s) % 2)  # everything collides
    array = url_filter.DigestArray.build([("block", f"h{i}.org", "/") for i in range(20)]).open()
    assert [array.find([f"h{i}.org/".encode()])[0] >= 0 for i in (0, 5, 19)] == [True] * 3
    assert array.find([b"h77.org/"])[0] == -1
    assert array.judge(["h3.org", "x.h3.org", "q.org"], ["/", "/a", "/"])[1] == ["block", "block", "allow"]


def test_reader_comments():
    from sparkloom.llm.html_extract import extract

    story = [f"Paragraph {i} tells what happened, with a comma and a stop." for i in range(3)]
    told = "".join(f"<p>{x}</p>" for x in story)
    said = "".join(f"<p>Comment {i} is much longer than the story's paragraphs: it goes on and on, friends, with many commas, as I was there, you know, and saw all of it; best regards, a reader from far away.</p>" for i in range(8))
    want = "\n".join(["Title", *story])
    pages = [
        f"<body><nav><a>Home</a></nav><div class='post'><h1>Title</h1>{told}</div><div class='comments'>{said}</div></body>",
        f"<body><div class='post'><h1>Title</h1>{told}<div id='disqus_thread'>{said}</div></div></body>",
        f"<body><article><h1>Title</h1>{told}<h3>Comments</h3><div class='comments'>{said}</div></article></body>",
        f"<body class='comments-open'><div><h1>Title</h1>{told}</div><section id='comments'><h2>8 replies</h2><ol class='comment-list'>{said}</ol></section></body>",
        f"<body><div class='hentry comments-open'><h1>Title</h1>{told}</div><div class='menu'><p>Menu</p></div></body>",
    ]
    assert [extract(p) for p in pages] == [want] * len(pages)
    assert extract(f"<body><article><h1>Title</h1><p>{story[0]}</p><div class='comment'>{said[:150]}</div></article></body>") == f"Title\n{story[0]}"
    # A heading that stands above text too stays, and comments are the text where there is no other.
    assert extract(f"<body><article><h2>Title</h2><span class='comment-count'>8</span>{told}</article></body>") == want
    assert extract(f"<body><div class='comments'>{told}</div></body>") == "\n".join(story)
