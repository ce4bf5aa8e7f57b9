"""The conversation trie, spelling variants and main text of pages against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veridelta.llm import html, queries, spelling, trie

CONVERSATIONS = "text string, conv_id long, turn long, role string, size long, block long, k1 long, t1 string, depth long"


def plain_trie(rows):
    """Nodes by the definition: every prefix of every rebuilt conversation in a dictionary."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    paths = {}
    for c, own in turns.items():
        own = [(r, t) for _, _, r, t in sorted(own, key=lambda x: (x[0], x[1], trie_order(x)))]
        base = [(r, t) for _, _, r, t in sorted(turns.get(c - int(np.fmod(c, 5)), []), key=lambda x: (x[0], x[1], trie_order(x)))]
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(base[:h] + own[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = set()
    for node, who in members.items():
        below = [(n, w) for n, w in members.items() if n[: len(node)] == node]
        kids = [n for n, _ in below if len(n) == len(node) + 1]
        leaves = [n for n, _ in below if not any(len(x) == len(n) + 1 and x[: len(n)] == n for x, _ in below)]
        saved = sum((len(w) - 1) * len(n[-1][1].encode()) for n, w in below if n)
        ends = ",".join(str(c) for c in sorted(w for w in who if len(paths[w]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(who), len(node), parent, len(who), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_order(row):
    """Equal turn numbers follow by digest, as the operator defines."""
    return hashlib.sha256(f"{len(row[2])}:{row[2]}{row[3]}".encode()).digest()[:16]


def conversations():
    rows = []
    for c in [*range(0, 23), -3, -5, 5001, 10**12]:
        long = 21 if c % 5 in (0, 1) else 3
        for t in range(long if c != 7 else 1):
            shared = t < 17 and c % 5 in (0, 1)
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if shared or c > 15 else f"turn {t} of {c} é"))
    for c in (40, 45, 50, 4096 * 3, 4096 * 9 + 5):  # the same conversation in several ranges of ids
        rows += [(c, 0, "user", "again"), (c, 1, "assistant", "and again")]
    rows += [(60, None, None, None), (60, 1, "user", "x"), (60, 1, "user", "x"), (60, 1, "user", "a"), (None, 1, "user", "no conversation"), (61, 3, "user", ""), (62, 3, None, "")]
    return rows


def test_trie_against_a_dictionary_of_prefixes(spark):
    rows = conversations()
    df = spark.createDataFrame([(x, c, t, r, 1, 2, 3, "k", 4) for c, t, r, x in rows], CONVERSATIONS)
    got = [tuple(r) for r in trie.prefix_trie(df.repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_of_no_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall(spelling.RUN, text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(known):
    near = {w: [x for x in known if is_near(w, x)] for w in known}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-known[x], x), default=None)
        form[w] = best if best is not None and known[best] >= 2 * known[w] else None
    out = set()
    for w in known:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, known[w], len(near[w]), known[form[w]] if form[w] else None))
    return out


def documents():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aabcé"), rng.integers(5, 9))) for _ in range(400)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "hotprefix", "hotprefiy", "hotprfix", "xhotprefix", "ÀÉÜÿß", "ÀÉÜÿßs", "q" * 4000, "q" * 4001]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(30)] + [None, "", "Hotprefix HOTPREFIX hotprefix1 hotprefix×÷"] + [" ".join(["q" * 4000, "q" * 4001])] * 4
    return [(None if k == 3 else k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("block", [spelling.BLOCK, 7])
def test_variants_against_all_pairs(spark, monkeypatch, block):
    """With blocks of 7 words every common half is cut into many tiles; the words are the same."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = documents()
    df = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], "doc_id long, text string, n long, word string, form string")
    got = [tuple(r) for r in spelling.variants(df.repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(plain_words(rows))


def test_variants_of_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


P = "A paragraph of the story that is long enough, with several clauses, to be read as prose."
PAGES = {
    "": "",
    "just text &lt;here&gt; &amp;c": "just text <here> &c",
    f"<html><body><div id='top'><a href='/'>Home</a> <a>News</a></div><div class='wrap'><h1>Title</h1><p>{P}</p><p>Short.</p><p>{P}</p></div><div><a>About</a> | <a>Contact</a></div>": f"Title\n{P}\nShort.\n{P}",
    f"<body><header><h1>Site</h1></header><div class='cookie-notice'>{P}</div><main><article><header><h1>T</h1></header><p>A&nbsp;b&amp;c \n d<p>{P}<aside>side</aside><ul><li>one<li>two</ul><form><label>mail</label></form></article>"
    f"<section class='comments'><article><p>{P} by a reader</p></article></section></main><aside>{P}</aside><footer>f</footer>": f"T\nA b&c d\n{P}\none\ntwo",
    f"<main><p>{P}</p></main><div>{P} elsewhere</div>": P,
    "<article><p>a<script>if (a</p>b) x</script>b<br>c</p><style>p{}</style>d</article>": "a\nb c\nd",
    "<article>a<!-- x <p>no</p> -->b<!-- cut off <p>no</p>": "ab",
    f"<article><p>{P} &am": f"{P} &am",
    f"<article><p>{P} <a href='": P,
    f"<article><p>{P}<b>bold <i>and</b> more</i><table><tr><td>1<td>2<tr><td>3</table>": f"{P}bold and more\n1\n2\n3",
    "<nav>menu</nav><div class='ad'>buy</div>": "",
}


def test_main_text_of_written_pages(spark):
    df = spark.createDataFrame([(k, f"http://x/{k}", page, "t") for k, page in enumerate(PAGES)] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html.extract(df).collect()}
    assert got.pop(None) == (None, "", 0)
    assert got == {k: (f"http://x/{k}", text, len(text)) for k, text in enumerate(PAGES.values())}
    assert html.extract(df.limit(0)).count() == 0


def test_main_text_of_pages_that_never_end():
    assert html.main_text("<div>" * 5000 + "x " * 50 + "</div>" * 5000) == ("x " * 50).strip()
    for odd in ("&amp;<x ", "<!-- x>", "<![CDATA[ x>", "<a href='", "</x y=", "<script>", "<b><i>", "</x>"):
        html.main_text(odd * 20000)  # in linear time


def test_smoothing_keeps_sums_of_even_lines():
    assert np.allclose(html.smoothed(np.full(9, 3.0)), 3.0)
    assert html.smoothed(np.array([0, 0, 9.0, 0, 0])).argmax() == 2


def test_queries_are_registered():
    assert {"op11_prefix_trie", "op12_spelling", "op13_main_text"} <= set(queries.QUERIES) & set(queries.ORACLE)
