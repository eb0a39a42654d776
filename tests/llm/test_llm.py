"""Each operator against brute force, a round trip or held-out accuracy, and its defined edge cases."""

import hashlib
import os
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("streamloom.llm")
from pyspark.sql import functions as F  # noqa: E402

from streamloom.llm import components, decontaminate, exact_dedup, html_text, language, line_dedup, near_dedup, pieces, sharding, substrings, token_files  # noqa: E402
from streamloom.llm.common import saved  # noqa: E402
from streamloom.llm.queries import vocabulary  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, id long, label string"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts, langs=None, sources=None):
    """Documents, with columns whose names clash with the operators' own."""
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else "s", 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 160))) for _ in range(25)]
    out = [None, "", "  \n ", "one", "One", "one two three"]
    for b in base:
        out += [b, b]
        words = b.split()
        for rate in (0.01, 0.04, 0.08):
            out.append(" ".join(rng.choice(WORDS) if rng.random() < rate else w for w in words))
    out.append("long " * 5000 + "end")
    return out


def test_near_duplicates(spark, texts):
    rows = {r.doc_id: r for r in near_dedup.near_duplicates(docs(spark, texts), words=4).collect()}
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert len(rows) == len(texts)
    for i in range(len(texts)):
        assert (rows[i].n_shingles, rows[i].component_id, rows[i].kept) == (len(sets[i]), find(i), find(i) == i)
    assert near_dedup.near_duplicates(docs(spark, [])).collect() == []


def test_near_duplicates_share_a_passage(spark):
    rng = random.Random(6)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage, texts = own(200), []
    for _ in range(200):
        middle = own(12)
        texts += [" ".join(own(24) + middle + passage) for _ in range(2)]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    alike = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    root = list(range(len(texts)))
    for i, j in sorted(linked, reverse=True):
        root[i] = min(root[i], j)
    assert len(linked) == 200 and all(i == j + 1 for i, j in linked)
    rows = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, texts), words=4).collect()}
    assert [rows[i] for i in range(len(texts))] == root


#: In a session of its own, as its JVM must find another chmod.
LAUNCHES = """
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from streamloom.llm.common import saved
from streamloom.llm.near_dedup import near_duplicates

spark = SparkSession.builder.master("local[2,2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
text = " ".join(map(str, range(40)))
rows = near_duplicates(spark.createDataFrame([(1, text), (2, text + " x"), (3, "y"), (4, None)], "doc_id long, text string"), words=4).collect()
assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 3, 4: 4}
assert not os.path.exists(sys.argv[1]), open(sys.argv[1]).read()

def once(batches):
    yield from batches
    if not TaskContext.get().attemptNumber():
        raise ValueError("the first attempt fails when its rows are written")

rows = spark.range(100, numPartitions=4).selectExpr("id", "if(id % 3 = 0, null, array(id)) as ids", "cast(cast(id as string) as binary) as key")
assert sorted(map(str, saved(rows, "t", once, "id long, ids array<long>, key binary").collect())) == sorted(map(str, rows.collect()))
assert saved(rows.filter("id < 0"), "t").collect() == [] and saved(rows, "t").count() == 100
"""


def test_near_duplicates_launch_nothing(tmp_path):
    """A process that an executor launches counts as a second executor until its program starts."""
    chmod, log, root = tmp_path / "chmod", tmp_path / "log", os.path.dirname(near_dedup.__file__) + "/../.."
    chmod.write_text(f'#!/bin/sh\ncase "$*" in */streamloom/*) echo "$@" >> {log};; esac\nexec /bin/chmod "$@"\n')
    chmod.chmod(0o755)
    env = os.environ | {"PATH": f"{tmp_path}:{os.environ['PATH']}", "PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}
    env = {k: v for k, v in env.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    run = subprocess.run([sys.executable, "-c", LAUNCHES, str(log)], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]


def python_at_end(plan):
    """Whether a Python function runs in the tasks that end plan."""
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    name, children = plan.nodeName(), plan.children()
    if "Exchange" in name or "QueryStage" in name:
        return False
    return "InArrow" in name or "InPandas" in name or any(python_at_end(children.apply(i)) for i in range(children.size()))


def test_near_duplicates_take_one_worker_a_task(spark, monkeypatch):
    """What saved() is given must not end in a Python function: that would be a second worker, which stays."""
    seen = []

    def recorded(df, name, run=None, schema=None):
        seen.append((name, python_at_end(df._jdf.queryExecution().executedPlan())))
        return saved(df, name, run, schema)

    for module in (near_dedup, components):
        monkeypatch.setattr(module, "saved", recorded)
    words = [f"v{i}" for i in range(60)]
    texts = [" ".join(words[:n]) for n in range(40, 61)]
    rows = near_dedup.near_duplicates(docs(spark, texts), words=4).collect()
    assert {r.component_id for r in rows} == {0}
    assert {"close", "links", "signed"} <= {name for name, _ in seen} and python_at_end(spark.range(3).mapInArrow(lambda b: b, "id long")._jdf.queryExecution().executedPlan())
    assert [name for name, python in seen if python] == []


def test_exact_duplicates(spark, texts):
    rows = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs(spark, texts)).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        assert (rows[i].keep_id, rows[i].group_size, rows[i].kept) == (max(g), len(g), i == max(g))
        assert rows[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert exact_dedup.exact_duplicates(docs(spark, [])).collect() == []
    dealt = exact_dedup.exact_duplicates(docs(spark, texts), hot_bytes=300)  # groups of several tasks
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, rows.values()))


def test_sharding(spark, texts):
    for n in (0, 5, 16, 83):
        rows = sharding.shard_documents(docs(spark, (texts * 2)[:n])).collect()
        counts = Counter(r.shard for r in rows)
        assert len(rows) == n and (not n or max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1)
        for s in counts:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert all(r.text_crc32 == zlib.crc32(((texts * 2)[r.doc_id] or "").encode()) for r in rows)


def test_sharding_by_brute_force(spark):
    """Key by key: each takes the first shard clockwise of its point that has room."""
    n, shards, nodes = 700, 16, sharding.ring(16, 16)
    ids = [i * 7 for i in range(n)]
    keys = []
    for i in ids:
        digest = hashlib.md5(str(i).encode()).hexdigest()
        point = int(digest[:8], 16)
        arc = next((a for a, (p, _) in enumerate(nodes) if p >= point), 0)
        keys.append((int(digest[8:12], 16) % sharding.BUCKETS, arc, digest, i))
    room = [n // shards + (s < n % shards) for s in range(shards)]
    want, used = {}, [0] * shards
    for _, arc, _, i in sorted(keys):
        s = next(nodes[(arc + k) % len(nodes)][1] for k in range(len(nodes)) if used[nodes[(arc + k) % len(nodes)][1]] < room[nodes[(arc + k) % len(nodes)][1]])
        want[i] = (s, used[s])
        used[s] += 1
    rows = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(rows).collect()} == want


def test_sharding_of_one_hot_key(spark):
    rows = spark.createDataFrame([(7 if i < 300 else i, "x") for i in range(900)], "doc_id long, text string")
    out = sharding.shard_documents(rows, cell_rows=40).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [56] * 12 + [57] * 4
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_lines(spark):
    body = [f"line {i}" for i in range(12)]
    texts = [f"menu\n{b}\n menu " for b in body] + [None, "", "menu", "x\nx"]
    sources = ["a"] * 12 + ["a", "a", "b", None]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts, sources=sources), ratio=0.5).collect()}
    assert [out[i].text for i in range(12)] == body
    assert out[12].text is None and out[13].text == "" and out[14].text == "menu" and out[15].text == "x\nx"
    assert (out[0].n_lines, out[0].n_dropped) == (3, 2)
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav>
<div class="ad">Buy the thing now, it is the best of all and you will not regret it at any time of the year.</div>
<article><h1>Title &amp; more</h1><p><b>First&nbsp;block
 of the text.<br><p>Second.</p><aside>Related and more of the same in a long list that nobody reads.</aside></article>
<section class="comments"><p>I think that this is the best of all the articles I have read in the year.</p></section><footer>&copy; x</footer>"""


def test_html():
    assert html_text.main_text(PAGE) == "Title & more\nFirst block of the text.\nSecond."
    assert html_text.main_text(None) == html_text.main_text("") == ""
    plain = "<div id=menu><a>x</a></div><div><h2>Head</h2><p>" + "this is what the people of the town have said to us. " * 3 + "</p><p>Short one.</p></div><p><a href=#>all links</a></p>"
    assert html_text.main_text(plain).split("\n")[0] == "Head"
    assert html_text.main_text(plain).endswith("Short one.")
    assert html_text.main_text("<p>a <unclosed \" <p>") is not None


def test_html_rules():
    prose = "this is what the people of the town have said to us. " * 3
    names = "Anna Berta Clara Dora Emil Fritz Gustav Heinrich Ida Julius Karl Ludwig Martha "
    page = f"<article><h1>Head</h1><p>{prose}</p><p>{names}</p><p>Short.</p><div class='legal tags'><p>{prose}</p></div><p style='overflow: hidden ; top: 0'>Seen.</p><div hidden>Unseen</div><div class=share>Share it</div></article><p>{names}</p><p>Elsewhere</p>"
    found = html_text.blocks(page)
    html_text.classify(found)
    rules = {b.text[:9].strip(): (b.label, b.rule) for b in found}
    assert rules["Short."] == rules["Seen."] == (True, "neighbour") and rules["Unseen"] == rules["Share it"] == (False, "container")
    assert rules["Elsewhere"] == (False, "place") and [b.rule for b in found if b.text.startswith("this")] == ["words"] * 2
    assert html_text.main_text(page) == "\n".join(["Head", prose.strip(), names.strip(), "Short.", prose.strip(), "Seen."])


def test_html_of_the_sample(spark):
    """On real pages the two passes decide every block of the article; the text is that of a plain parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.out = 0, [""]

        def handle_starttag(self, tag, attributes):
            self.inside += tag == "article"
            self.out += [""] if tag in ("p", "h1", "article") else []
            self.out[-1] += " " * (tag == "br")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.out += [""] if tag in ("p", "h1", "article") else []

        def handle_data(self, data):
            self.out[-1] += data if self.inside else ""

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    rules = Counter()
    for p in pages.collect():
        parser = Article()
        parser.feed(p.html)
        text = "\n".join(t for t in (" ".join(x.split()) for x in parser.out) if t)
        assert rows[p.page_id].text == text and rows[p.page_id].n_chars == len(text) and rows[p.page_id].url == p.url
        found = html_text.blocks(p.html)
        html_text.classify(found)
        rules.update(b.rule for b in found if b.label)
    assert rules["words"] + rules["neighbour"] > 50 * rules["place"]


def test_decontamination(spark):
    rng = random.Random(3)
    items = [" ".join(rng.choices(WORDS, k=30)) for _ in range(6)]
    edited = items[1].split()
    for i in (7, 15, 22):
        edited[i] = "other"
    noise = [" ".join(rng.choices(WORDS, k=200)) for _ in range(30)]
    texts = [*noise, noise[0] + " " + items[0].upper() + " " + noise[1], noise[2] + " " + " ".join(edited), None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert set(found) == {(30, 0), (31, 1)} and found[30, 0] == 1.0 and 0.8 < found[31, 1] < 1
    kept = decontaminate.decontaminate(docs(spark, texts), bench)
    assert kept.count() == len(texts) - 2
    assert decontaminate.contaminated(docs(spark, []), bench).collect() == []
    assert decontaminate.contaminated(docs(spark, texts), bench.filter("false")).collect() == []


def test_decontamination_of_edited_copies(spark):
    rng = random.Random(12)
    noise = [" ".join(rng.choices(WORDS, k=120)) for _ in range(40)]
    items = [" ".join(rng.choices(WORDS, k=32)) for _ in range(8)]

    def edited(item, start):
        return " ".join(f"x{rng.randrange(10**6)}" if i % 5 == start else w for i, w in enumerate(item.split()))

    texts = noise + [f"{noise[i]} {edited(t, i % 5)} {noise[i + 1]}" for i, t in enumerate(items)]
    texts += [f"{noise[i]} {edited(items[0], i % 5)}" for i in range(10)]  # a group of copies
    texts.append(noise[9] + " alpha beta gamma wrong " + noise[8])  # one seed is all that is left of item 8
    bench = spark.createDataFrame(list(enumerate([*items, "alpha beta gamma delta"])), "item_id long, text string")
    want = {(40 + i, i) for i in range(8)} | {(48 + i, 0) for i in range(10)} | {(58, 8)}
    for rows in (texts, texts + [" ".join(rng.choices(WORDS, k=9)) for _ in range(1500)]):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()} == want


def test_decontamination_by_brute_force(spark):
    """Items with words replaced, against alignments of all pairs: all are found, whatever the share of edits."""
    rng = random.Random(21)
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = bench.orderBy("item_id").limit(40).collect()
    noise = [" ".join(rng.choices(WORDS, k=60)) for _ in range(10)]
    texts = []
    for k in range(80):
        rate = (0.1, 0.2, 0.25, 0.3)[k % 4]
        words = [rng.choice(WORDS) if rng.random() < rate else w for w in rng.choice(items).text.split()]
        texts.append(f"{rng.choice(noise)} {' '.join(words)} {rng.choice(noise)}")
    known = decontaminate.Items([r.item_id for r in items], [r.text for r in items])
    want = set()
    for d, t in enumerate(texts):
        words = decontaminate.Items([0], [t]).words
        want |= {(d, items[i].item_id) for i in range(len(items)) if decontaminate.align(known.item(i), words)[0] >= 0.5 * 2 * len(known.item(i))}
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), bench.filter(F.col("item_id").isin([r.item_id for r in items]))).collect()}
    assert found == want and len({d for d, _ in want}) > 70


def test_short_items(spark):
    bench = spark.createDataFrame([(0, "quantum flux"), (1, "Xylophone!"), (2, "?!")], "item_id long, text string")
    texts = ["the quantum, flux of it", "quantum of flux", "a xylophone plays", "quantum flux", "?!"]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert found == {(0, 0), (3, 0), (2, 1)}


def test_most_points():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 30, 12), rng.integers(0, 30, 40)
        assert decontaminate.most_points(a, b) >= decontaminate.align(a, b)[0]


def naive_align(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 20)
        assert decontaminate.align(a, b)[0] == naive_align(a, b)


@pytest.mark.parametrize("most, often", [(50_000, 10_000), (2, 1)])
def test_repeats(spark, most, often):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcdé ", k=n))
    passage, n = text(60), 40
    texts = [text(100) + passage + text(80), passage, text(50) + passage[5:], text(30), text(30) * 3, None, "", text(200), "aaaa" * 30]
    texts += [texts[7], texts[7]]
    blobs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in blobs for i in range(len(b) - n + 1))
    got = {r.doc_id: r for r in substrings.remove_repeats(docs(spark, texts), n, most, often=often).collect()}
    for d, b in enumerate(blobs):
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("n", [2, 3, 12, 60])
def test_repeat_groups(n):
    rng = random.Random(n)
    for letters in (b"ab", b"aaaab"):
        lefts = [bytes(rng.choices(letters, k=rng.randrange(12, 20))) for _ in range(n)]
        rights = [bytes(rng.choices(letters, k=20)) for _ in range(n)]
        lefts[-1], rights[-1] = lefts[0], rights[0]
        if n > 2:
            rights[1] = rights[0]
        cover, seen = [set() for _ in lefts], set()
        for left, right, members in substrings.repeats(lefts, rights, 6):
            assert left + right >= 6 and len({lefts[m][:left] for m in members}) == len({rights[m][:right] for m in members}) == 1
            # All occurrences, and none further on either side.
            assert set(members) == {m for m in range(n) if lefts[m][:left] == lefts[members[0]][:left] and rights[m][:right] == rights[members[0]][:right]}
            assert len({lefts[m][left : left + 1] for m in members}) > 1 or min(len(lefts[m]) for m in members) == left
            assert len({rights[m][right : right + 1] for m in members}) > 1 or min(len(rights[m]) for m in members) == right
            assert (left, right, frozenset(members)) not in seen
            seen.add((left, right, frozenset(members)))
            for m in members:
                cover[m] |= set(range(-left, right))
        # Every string of 6 bytes through the anchor that occurs twice is covered.
        for m in range(n):
            for x in range(7):
                if x <= len(lefts[m]) and sum(lefts[o][:x] == lefts[m][:x] and rights[o][: 6 - x] == rights[m][: 6 - x] for o in range(n)) > 1:
                    assert set(range(-x, 6 - x)) <= cover[m]
        found = {i: set().union(*(range(-x, y) for x, y in spans)) for i, spans, _ in substrings.in_anchor(lefts, rights, 6)}
        assert [found.get(m, set()) for m in range(n)] == cover
        sizes = {i: size for i, _, size in substrings.in_anchor(lefts, rights, 6)}
        if n <= substrings.FEW and len(set(zip(lefts, rights, strict=True))) == n:
            assert all(sizes[m] == max(len(g) for _, _, g in seen if m in g) for m in sizes)


def test_language(spark):
    rng = random.Random(4)
    vocabularies = {"aa": [f"{x}ka{y}" for x in "bdfg" for y in "mnrst"], "bb": [f"{x}ol{y}e" for x in "chjw" for y in "ptvz"]}
    langs = ["aa", "bb"] * 60
    texts = [" ".join(rng.choices(vocabularies[k], k=40)) for k in langs] + [None, "", "12 34 !!"]
    out = {r.doc_id: r for r in language.identify(docs(spark, texts, langs + [None, "aa", "bb"])).collect()}
    held = [i for i in range(120) if out[i].held_out]
    assert held and all(out[i].lang_pred == langs[i] for i in held)
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= out[i].score <= 1 for i in range(123))
    assert [out[i].lang_pred for i in (120, 121, 122)] == ["und"] * 3
    assert language.accepted(docs(spark, texts, langs + [None, "aa", "bb"])).count() == 120
    assert language.identify(docs(spark, [])).collect() == []


def test_language_of_long_texts():
    rng = random.Random(7)
    vocabularies = {k: ["".join(rng.choices("abcdefghijkl", k=rng.randrange(3, 9))) for _ in range(4000)] for k in ("aa", "bb")}
    classify = language.Classifier({k: " ".join(rng.choices(v, k=30_000)).encode() for k, v in vocabularies.items()})
    for k, v in vocabularies.items():
        found = [classify(" ".join(rng.choices(v, k=n))) for n in (3_000, 500_000)]
        assert [x[0] for x in found] == [k, k] and not any(x[2] for x in found)
        assert found[1][1] > 0.9 * found[0][1]  # the margin doesn't shrink with length


def test_language_of_the_sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(rows).join(rows.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(out) > 100 and sum(r.lang_pred == r.lang for r in out) > 0.95 * len(out)


def test_language_counts_letters_only():
    classify = language.Classifier({"aa": b"aka abka abka", "bb": b"bolo bole"})
    assert [classify(t)[0] for t in (None, "", "½ ² ³", "Ⅷ ①", "12 !", "abka")] == ["und"] * 5 + ["aa"]
    long = "abka " * 120_000
    assert "".join(language.stretches(long)) == long and max(map(len, language.stretches(long))) < language.STRETCH + 10


TRICKY = [None, "", " ", "a", "Plain words, here.", "two  spaces", "line\nbreak\n", "\ttab", "l'été d’hiver 12 34.5!", "日本語 の", "x" * 300, "<|endoftext|> z", "a b", "don't we're"]


def test_tokens(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    all_texts = TRICKY + texts
    files = token_files.write_tokens(docs(spark, all_texts), vocabulary("byte_bpe_50k.json"), partitions=3)
    got = {r.doc_id: r for r in token_files.read_tokens(files).collect()}
    start = 0
    for i, x in enumerate(all_texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read_tokens(token_files.write_tokens(docs(spark, []), vocabulary("byte_bpe_50k.json"))).collect() == []


def test_grammar():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 9, 5000), np.zeros(101, int), np.array([7]), np.array([], int), np.tile([1, 2, 3], 700)):
        rules, left = token_files.compress(ids.astype(np.uint32), 9, least=3)
        lengths = token_files.expansion_lengths(rules, 9)
        assert (token_files.expand(left, rules, 9, lengths) == ids).all() and len(left) <= len(ids)
        pairs = Counter(zip(left[:-1].tolist(), left[1:].tolist(), strict=True))
        assert not pairs or max(pairs.values()) < 6  # to the end, but for overlapping pairs
        row = {"symbols": left.astype("<u4").tobytes(), "wide": True, "base": 9, "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes()}
        for a, b in ((0, len(ids)), (3, 50), (len(ids) // 2, len(ids) // 2 + 1)):
            if b <= len(ids) and a < b:
                assert (token_files.decode_range(row, a, b) == ids[a:b]).all()
    wide = np.tile(rng.integers(0, 70_000, 500), 8).astype(np.uint32)  # a vocabulary beyond 16 bits is compressed, too
    assert len(token_files.compress(wide, 70_000)[1]) < len(wide) // 2


def strange(n, seed):
    """Random texts of letters, digits, marks, white space of all kinds and characters of several scripts."""
    rng = random.Random(seed)
    letters = "ab1,.' \n\té  日<|>½ʼʰ\u0301▁😀theing\x1c\u2003"
    return ["".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(n)]


def test_encoder():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    encode = token_files.Encoder(vocabulary("byte_bpe_50k.json"))
    long = ["".join(strange(15_000, 2)), "x " * 200_000, "y" * 300_000]
    for texts in (TRICKY + strange(4000, 1), long):
        ids, bounds = encode(texts)
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_units_are_forgotten_and_found_again():
    from streamloom.llm.units import UnitCoder

    coder = UnitCoder(lambda points, first: (first | (points == 32),) * 2, lambda units: (np.array([ord(c) for u in units for c in u], np.uint32), np.array([len(u) for u in units])))
    coder.KEEP = 500
    rng = random.Random(3)
    for _ in range(30):
        texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(60))) for _ in range(5)]
        ids, bounds = coder(texts)
        assert ["".join(map(chr, ids[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == texts


def test_pieces(spark, texts):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    own, lib = pieces.Coder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    all_texts = [t for t in TRICKY + texts + strange(3000, 4) + ["".join(strange(9000, 5))] if t]
    _, ids, bounds = own(all_texts)
    data, begins, ends = own.model.decode_all(ids, bounds)
    for k, t in enumerate(all_texts):
        found = ids[bounds[k] : bounds[k + 1]].tolist()
        assert found == lib.encode(t)
        assert own.model.decode(found) == data[begins[k] : ends[k]].tobytes().decode() == t.replace(pieces.MARK, " ")
    rows = pieces.decode_pieces(pieces.encode_pieces(docs(spark, [None, "", "ab cd"]), path), path).orderBy("doc_id").collect()
    assert [r.piece_text for r in rows] == [None, "", "ab cd"] and rows[0].piece_ids is None
    assert pieces.piece_digests(docs(spark, [None, "x", *TRICKY]), path).filter(~F.col("round_trip")).count() == 0


def test_sums_of_scores(spark, tmp_path):
    """The unigram search gives the library's ids; on the BPE model, greatest sums of scores don't give its ids."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    rows = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r[0]]
    words = sorted({w for t in rows for w in t.split()})
    found = []
    for scores in ("own", "logarithms"):
        for i, p in enumerate(m.pieces if scores != "own" else []):
            p.score = -float(np.log(i + 2)) - (i % 97) / 1000
        path = str(tmp_path / f"{scores}.model")
        with open(path, "wb") as f:
            f.write(m.SerializeToString())
        own, library = pieces.Coder(path), sentencepiece.SentencePieceProcessor(model_file=path)
        score = np.array([p.score for p in m.pieces])
        _, ids, bounds = own(words)
        same = 0
        for k, t in enumerate(words):
            mine, other = ids[bounds[k] : bounds[k + 1]].tolist(), library.encode(t)
            assert scores == "own" or score[mine].sum() >= score[other].sum() - 1e-6
            same += mine == other
        found.append((same, ids, bounds))
        assert same > 0.99 * len(words)  # the library adds scores in single precision
    bpe = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    _, ids, bounds = found[0]
    assert sum(ids[bounds[k] : bounds[k + 1]].tolist() != bpe.encode(t) for k, t in enumerate(words)) > len(words) // 4


def test_pipeline_decodes(spark):
    import corpus_pipeline as p

    rows = p.sentencepiece(spark, docs(spark, [None, "", "ab cd", *TRICKY]), "")
    same = pieces.decode_pieces(rows.withColumnRenamed("piece_text", "own"), vocabulary("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [r.own for r in same] == [r.piece_text for r in same] and [r.own for r in same[:3]] == [None, "", "ab cd"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(8)
    base = [" ".join(rng.choices(WORDS, k=80)) for _ in range(12)]
    item = " ".join(rng.choices(WORDS, k=30))
    rows = [f"common top line\n{b}" for b in base] + [f"common top line\n{base[0]}", f"common top line\n{base[1]} {item}", "12 ?!"]
    d = docs(spark, rows).select("doc_id", "text", "lang", "source").withColumn("n_chars", F.char_length("text").cast("long"))
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in p.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(12)) and all(out[i].text == base[i] for i in out) and all(out[i].piece_ids for i in out)


STRANGE_KIND = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, row string, n_lines string, bytes string, k long, h long, site string, group long, piece_ids string, piece_text string, component_id string"


@pytest.fixture(scope="module")
def odd_rows():
    """Null and repeated doc_ids (of the same and of other texts), null, empty, blank and long texts, ties."""
    rng = random.Random(31)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    a, b, c = prose(90), prose(90), prose(120)
    tail = prose(120)
    rows = [(5, a), (5, b), (6, a), (7, b), (None, a), (None, c), (None, c), (8, c + " more"), (9, None), (9, None), (10, ""), (11, "  \n "), (12, "x"), (12, "x"), (13, "long words " * 60_000), (14, f"start {tail}"), (14, f"other {tail}"), (None, None), (15, f"menu\n{prose(30)}"), (15, f"first\nmenu\n{prose(30)}"), (None, f"menu\n{prose(30)}"), (16, "日本語 ½ é"), (2**40, a)]
    return rows


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "de", "s", 1, 3, 4, "r", "n", "b", 1, 2, "z", 5, "p", "q", "c") for i, t in rows], STRANGE_KIND)


def test_odd_rows_near(spark, odd_rows):
    out = near_dedup.near_duplicates(odd(spark, odd_rows), words=4).collect()
    of = lambda i, n: sorted((r.component_id is None, r.component_id or 0, r.kept) for r in out if r.doc_id == i and (n is None or r.n_shingles == n))
    assert len(out) == len(odd_rows) and of(9, 0) == [(False, 9, True)] * 2 and of(12, 1) == [(False, 12, True)] * 2
    assert of(5, None) == [(False, 5, True)] * 2 and of(6, None) == [(False, 5, False)] == of(7, None) == of(2**40, None)
    assert (False, 8, False) in of(None, None) and (False, 5, False) in of(None, None)  # null ids go with the others
    assert of(14, None) == [(False, 14, True)] * 2
    kept = near_dedup.drop_near_duplicates(odd(spark, odd_rows), words=4)
    assert kept.columns == odd(spark, []).columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [5, 5, 8, 9, 9, 10, 11, 12, 12, 13, 14, 14, 15, 15, 16]
    alone = near_dedup.near_duplicates(odd(spark, [(None, "a b c d e"), (None, "a b c d e"), (None, None)]), words=4).collect()
    assert sorted((r.n_shingles, r.kept) for r in alone) == [(0, True), (2, False), (2, True)]


def test_odd_rows_exact(spark, odd_rows):
    out = exact_dedup.exact_duplicates(odd(spark, odd_rows)).collect()
    want = []
    for i, t in odd_rows:
        same = [j for j, u in odd_rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


def test_odd_rows_shards_and_lines(spark, odd_rows):
    out = sharding.shard_documents(odd(spark, odd_rows)).collect()
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in odd_rows)
    assert len({(r.shard, r.slot) for r in out}) == len(odd_rows)
    placed = sharding.shard(odd(spark, odd_rows), F.col("doc_id"))
    assert set(placed.columns) == set(odd(spark, []).columns) and placed.count() == len(odd_rows)
    for most in (1 << 20, 0):  # by a broadcast and by a join
        lines = line_dedup.dedup_lines(odd(spark, odd_rows), ratio=0.1, broadcast_lines=most)
        rows = lines.collect()
        assert lines.columns == [c for c in odd(spark, []).columns if c != "n_lines"] + ["n_lines", "n_dropped"]
        drop = lambda t: None if t is None else "\n".join(x for x in t.split("\n") if x.strip() not in bad)
        pages = Counter(x for _, t in odd_rows for x in {y.strip() for y in (t or "").split("\n")} if x)
        bad = {x for x, n in pages.items() if n >= 3 and n > 0.1 * len(odd_rows)}
        assert "menu" in bad
        key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
        assert sorted(((r.doc_id, r.text) for r in rows), key=key) == sorted(((i, drop(t)) for i, t in odd_rows), key=key)


def test_lines_of_copies(spark):
    texts = ["own line\nanother"] * 6 + [f"menu\nunlike {i}" for i in range(20)]
    once = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts), once=True).collect()}
    assert [once[i] for i in range(6)] == texts[:6] and once[7] == "unlike 1"
    each = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert each[0] == "" and each[7] == "unlike 1"


def test_odd_rows_repeats(spark, odd_rows):
    rows = [*odd_rows, (None, "z" * 900), (20, "q" * 600 + "r"), (20, "b")]
    out = substrings.remove_repeats(odd(spark, rows), 60, seen=50).collect()
    blobs = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + 60] for b in blobs for i in range(len(b) - 59))
    want = []
    for (d, _), b in zip(rows, blobs, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 59):
            if seen[b[i : i + 60]] > 1:
                gone[i] += 1
                gone[i + 60] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        want.append((d, len(b), int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    key = lambda r: (r[0] is None, *(x or 0 for x in r[:3]), r[3])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in out), key=key) == sorted(want, key=key)
    # Passages of over 50 words: texts a, b and c with their copies, the long text, and both rows of 14.
    found = Counter(r.doc_id for r in out if r.repeated)
    assert found[5] == 2 and found[14] == 2 and found[13] == 1 and found[None] == 3 and not found[16] and not found[20]


def test_passages(spark):
    """A passage of over 50 words is told although it is shorter than the strings that go."""
    rng = random.Random(41)
    own = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    passage, short = " ".join(rng.choices(["over", "under", "the", "bridge"], k=57)), own(30)
    texts = [f"{own(20)} {passage} {own(20)}", f"{own(9)} {passage}", f"{own(40)} {short}", f"{short} {own(9)}", own(80)]
    assert len(passage) < 400
    out = {r.doc_id: r for r in substrings.remove_repeats(docs(spark, texts)).collect()}
    assert [out[i].repeated for i in range(5)] == [True, True, False, False, False] and not any(r.n_removed for r in out.values())
    assert out[0].n_group == 2 and out[4].n_group == 0


def test_odd_rows_language_leaks_tokens_pieces(spark, odd_rows):
    from tokenizers import Tokenizer

    rows = odd(spark, odd_rows)
    assert language.identify(rows).count() == len(odd_rows) and language.accepted(rows).columns == rows.columns
    bench = spark.createDataFrame([(None, odd_rows[0][1]), (3, odd_rows[1][1]), (3, odd_rows[1][1])], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, bench).collect()}
    assert found == {(5, None), (5, 3), (6, None), (7, 3), (None, None), (2**40, None)}
    clean = decontaminate.decontaminate(rows, bench)
    assert clean.columns == rows.columns and clean.count() == len(odd_rows) - 6
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = sorted(token_files.read_tokens(token_files.write_tokens(rows, vocabulary("byte_bpe_50k.json"), partitions=3)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in odd_rows), key=lambda i: -1 if i is None else i)
    at, crc = 0, Counter()
    for r in got:
        assert r.start == at
        at += r.n_tokens
        crc[r.doc_id, r.ids_crc32] += 1
    assert crc == Counter((i, zlib.crc32(np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in odd_rows)
    path = vocabulary("piece_bpe_32k.model")
    coded = pieces.encode_pieces(rows, path, decoded=True)
    assert sorted(coded.columns) == sorted(rows.columns)
    assert Counter((r.doc_id, r.piece_text) for r in coded.collect()) == Counter(odd_rows)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    none = odd(spark, [])
    path = vocabulary("piece_bpe_32k.model")
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert pieces.encode_pieces(none, path).collect() == [] and pieces.piece_digests(none, path).collect() == []
    assert sharding.shard_documents(none).collect() == [] and substrings.remove_repeats(none).collect() == []
    spark.createDataFrame([(0, "some item of the benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in p.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.collect() == [] and (name == "sentencepiece" or out.columns == none.columns)


def test_odd_rows_through_the_stages(spark, odd_rows, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(0, odd_rows[1][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = odd(spark, odd_rows)
    for name, stage in p.STAGES:
        rows = stage(spark, rows, str(tmp_path))
        assert name == "sentencepiece" or rows.columns == odd(spark, []).columns
    out = rows.collect()
    assert all(r.text is not None and r.piece_text == r.text for r in out) and not any(r.doc_id in (6, 7) for r in out)


def test_html_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "y"), (1, "u", "<p>" + "of the " * 50_000, "z"), (1, None, "<b>x</b>", "q")], "page_id long, url string, html string, text string")
    out = sorted(html_text.extract_text(rows).collect(), key=lambda r: r.n_chars)
    assert [(r.page_id, r.url, r.n_chars) for r in out] == [(None, None, 0), (1, "u", 0), (1, None, 0), (1, "u", 349_999)]


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from streamloom import core

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        core.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
