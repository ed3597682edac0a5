"""Archives, extraction, URL verdicts and role repair on small tables."""

import gzip
import hashlib
import itertools
import os
import random
import re
from collections import defaultdict

import pytest

from eventloom.llm import chat, extract, urlgraph, warc
from eventloom.llm.common import neighbours


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, text string")


def test_archives_round_trip(spark):
    rows = [
        (1, None, "a" * 200, "x", "y"), (2, "http://x y\r\n", None, "x", "y"), (3, "u", "é" * 60_000, "x", "y"), (4, "v", "a" * 200, "x", "y"),
        (None, "n", "a" * 200, "x", "y"), (5, "s", "zz", "x", "y"), (6, "s", "zz", "x", "y"), (7, "s", "WARC/1.1\r\n\r\n" * 9000, "x", "y"), (1, "again", "a" * 200, "x", "y"),
    ]
    df = pages(spark, rows)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(df).collect()), key=str)
    want = []
    for i, _, t, _, _ in rows:
        raw = (t or "").encode()
        again = i != 1 and t == "a" * 200
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)
    manifest = warc.write_archives(df)
    whole = defaultdict(bytes)
    for r in sorted(warc.read_chunks(manifest).collect(), key=lambda r: r.chunk_no):
        assert r.digest_ok and len(r.chunk) <= warc.CHUNK
        whole[r.record_id] += r.chunk
        assert r.record_type == "revisit" or r.record_id == "urn:x-page:1" or hashlib.sha256(whole[r.record_id]).hexdigest() == r.payload_digest
    assert whole["urn:x-page:3"] == ("é" * 60_000).encode() and whole["urn:x-page:7"] == b"WARC/1.1\r\n\r\n" * 9000
    # archives are plain gzipped WARC
    fs, path = warc.file_system(manifest.first().archive)
    raw = gzip.decompress(fs.open_input_file(path).read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: re") and raw.endswith(b"\r\n\r\n")
    assert warc.page_records(df.limit(0)).count() == 0


def test_archives_keep_the_type_of_ids(spark):
    rows = [("p/1 ä+%", "u", "a" * 200), ("", "u", "a" * 200), (None, "u", "a" * 200), ("urn:x", "u", "b")]
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.page_records(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {("", "response", None), ("p/1 ä+%", "revisit", ""), (None, "revisit", ""), ("urn:x", "response", None)}


def test_archives_split(spark):
    old, warc.SPLIT = warc.SPLIT, 500
    try:
        df = pages(spark, [(i, "u", "".join(random.Random(i).choice("abc") for _ in range(3000)), "", "") for i in range(60)]).coalesce(1)
        manifest = warc.write_archives(df)
        got = warc.read_chunks(manifest, with_payload=False).where("last")
        assert got.where("digest_ok").select("record_id").distinct().count() == 60
    finally:
        warc.SPLIT = old


def test_extraction(spark):
    rows = [
        (1, "http://h/a/1", "<body><div>Menu A</div><div>Title one</div><p>Body one &amp; x</p><div>Copyright</div>", "", ""),
        (2, "http://h/a/2", "<body><div>Menu A</div><div>Title two</div><p>Body two<div>Copyright</div>", "", ""),
        (3, "http://h/b/9", '<nav>x</nav><main><h1>T</h1>a<b>b</b>c<div class="share-bar">no</div> d</main><div>Copyright</div>', "", ""),
        (4, None, None, "", ""),
        (5, "http://z/", 'alone <script>if (a<b) "</p>"</script> here<!-- <p>no</p> -->', "", ""),
        (6, "http://y/", '<article><header><h2>Head</h2></header>x&nbsp;&lt;y&#x41;<br>z<section id="comments"><article>rude</article></section><form>f</form></article>', "", ""),
        (7, "http://y/", "<article>" + "<p>word</p>" * 30_000, "", ""),
        (8, "http://w/", "<div class='cookie-notice'>c<div>d</div>e</div><p title='a>b'>kept</p><aside>s</aside><footer>gone", "", ""),
    ]
    got = {r.page_id: (r.text, r.n_chars) for r in extract.extract(pages(spark, rows)).collect()}
    want = {1: "Title one Body one & x", 2: "Title two Body two", 3: "T abc d", 4: "", 5: "alone here", 6: "Head x <yA z", 7: " ".join(["word"] * 30_000), 8: "kept"}
    assert got == {k: (t, len(t)) for k, t in want.items()}
    assert extract.extract(pages(spark, rows).limit(0)).count() == 0


def test_copies_and_versions_of_a_page_are_no_partners(spark):
    page = "<div>Menu</div><p>Only text</p>"
    rows = [
        (1, "http://c/a", page), (2, "http://c/a", page), (3, "http://c/b", page),  # copies, and nothing else on the host
        (4, "http://d/x/1", page), (5, "http://d/x/1", page + "<p>added</p>"), (6, "http://d/x/9", "<div>Menu</div><p>Other</p>"),
    ]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Menu Only text", 2: "Menu Only text", 3: "Menu Only text", 4: "Only text", 5: "Only text added", 6: "Other"}


def text_by_hand(pages):
    """page_id -> text by the docstring's steps: all pages of a host in one list, a table of common subsequences."""
    lines = {i: extract.lines_of(html or "") for i, _, html in pages}
    split = {i: re.fullmatch(r"\w+://([^/?#]*)([^?#]*).*", url) for i, url, _ in pages}
    hosts = defaultdict(lambda: defaultdict(list))
    for i, url, _ in pages:
        hosts[split[i][1].lower()][tuple(lines[i])].append((split[i][2], url))
    out = {}
    for i, _, _ in pages:
        outlines = hosts[split[i][1].lower()]
        at = {o: min(urls) for o, urls in outlines.items()}
        versions = defaultdict(list)
        for o, place in at.items():
            versions[place].append(o)
        order, me = sorted(versions), at[tuple(lines[i])]
        k = order.index(me)
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order)]
        common = lambda p: len(os.path.commonprefix([p[0], me[0]]))
        shared = set()
        if near:
            best = max(near, key=common)
            choices = [[x for x, _ in o] for o in versions[best]]
            a = [x for x, _ in lines[i]]
            found = [longest(a, b) for b in choices]
            assert len(found) == 1
            shared = set(found[0])
        owned = any(kind == extract.OWNED for _, kind in lines[i])
        out[i] = " ".join(x for j, (x, kind) in enumerate(lines[i]) if kind == extract.OWNED or (j not in shared and kind == extract.OUTSIDE and not owned))
    return out


def longest(a, b):
    """Places in a of a longest common subsequence, by the full table."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif n[i + 1][j] >= n[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_differencing_against_all_pages_of_a_host(spark, parts):
    r = random.Random(11)
    rows = []
    for k in range(90):
        body = "".join(f"<p>body {k} {j}</p>" for j in range(r.randint(1, 4)))
        menu = "<div>Home</div><div>Products</div>" if k % 3 else "<div>Home</div>"
        page = f"{menu}{body}<nav>nav {k % 2}</nav><div>Copyright</div>" if k % 5 else f"{menu}<article>{body}<p>Copyright</p></article><div>Imprint {k}</div>"
        rows.append((k, f"http://H{k % 4}.org/{'abc'[k % 3]}/{r.randint(0, 40)}?q={k}", page))
    rows += [(200, "http://h1.org/a/1", rows[4][2]), (201, "http://h9.org/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = extract.extract(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = text_by_hand(rows)
    assert {x.page_id: x.text for x in got} == want and sum(x.n_shared for x in got) > 50
    kept = sum(len(extract.lines_of(html or "")) for _, _, html in rows) - sum(x.n_shared + x.n_structure for x in got)
    assert kept == sum(len(re.findall(r"body \d+ \d+|nav \d|Home|Products|Copyright|Imprint \d+", text)) for text in want.values())


@pytest.mark.parametrize("seed", range(30))
def test_common_lines_is_a_longest_common_subsequence(seed):
    r = random.Random(seed)
    a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 14))] for _ in range(2))
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    got = extract.common_lines(a, b)
    rest = iter(b)
    assert got == sorted(set(got)) and len(got) == n[-1][-1] and all(a[k] in rest for k in got)


def test_neighbours_cross_ranges(spark):
    df = spark.createDataFrame([(k // 10, k) for k in range(57)], "g long, k long").repartition(7)
    got = {r.k: (r.before and r.before.k, r.after and r.after.k) for r in neighbours(df, ["g", "k"], ["g", "k"]).collect()}
    assert got == {k: (k - 1 if k else None, k + 1 if k < 56 else None) for k in range(57)}


def test_url_verdicts(spark):
    rows = [
        (1, "https://a.net/x", '<a href="https://good.org/">'), (2, "http://Spam.org/a?b", "<a class=x href=//a.net/z>"), (3, "http://good.org/fr/1", ""),
        (4, None, None), (5, "nohost", ""), (6, "http://b.org?q", " "), (7, "http://www.example.net/en/1#x", '<a href="http://b.org/x">'),
        (8, "http://EXAMPLE.com/de/", ""), (9, "://", ""), (10, "http://notexample.com/de/", ""), (11, "http://net/", ""), (12, "x://u@h.net:80/en/", ""),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("spam.org", "/a", None, "block"), 3: ("good.org", "/fr/1", "org/fr/", "allow"), 4: ("", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("b.org", "", None, "allow"), 7: ("www.example.net", "/en/1", "example.net/en/", "allow"),
        8: ("example.com", "/de/", "example.com/de/", "block"), 9: ("", "", None, "allow"), 10: ("notexample.com", "/de/", None, "allow"),
        11: ("net", "/", "net/", "block"), 12: ("u@h.net:80", "/en/", None, "allow"),
    }


def test_scores_match_a_dense_solution(spark):
    import numpy as np

    r = random.Random(2)
    hosts = [f"h{k}" for k in range(12)]
    edges = {(a, b): r.randint(1, 4) for a in hosts for b in hosts if a != b and r.random() < 0.3}
    seed = {h: float(k % 4 == 0) for k, h in enumerate(hosts)}
    got = urlgraph.spread(
        spark.createDataFrame(list(seed.items()), "host string, seed double"),
        spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long"), "seed",
    )
    out = {h: sum(n for (a, _), n in edges.items() if a == h) for h in hosts}
    m = np.array([[edges.get((a, b), 0) / out[a] if out[a] else 0 for a in hosts] for b in hosts])
    want = np.linalg.solve(np.eye(12) - 0.85 * m, 0.15 * np.array([seed[h] for h in hosts]))
    have = {x.host: x.score for x in got.collect()}
    # the iteration stops when the rest of the series is small
    assert np.allclose([have[h] for h in hosts], want, atol=urlgraph.TOLERANCE)


def test_scores_that_spread_thin_and_meet_again(spark, monkeypatch):
    """A seed, nine hops, a host that links to many that all link to one: each of the many changes by less than the tolerance."""
    many = 1000
    monkeypatch.setattr(urlgraph, "TOLERANCE", 2e-4)
    edges = [(f"h{k}", f"h{k + 1}") for k in range(9)] + [("h9", f"m{k}") for k in range(many)] + [(f"m{k}", "last") for k in range(many)]
    names = sorted({x for e in edges for x in e})
    hosts = spark.createDataFrame([(x, float(x == "h0")) for x in names], "host string, good double")
    got = {r.host: r.score for r in urlgraph.spread(hosts, spark.createDataFrame([(*e, 1) for e in edges], "src string, dst string, n long"), "good").collect()}
    assert got["last"] == pytest.approx(0.15 * 0.85**11, abs=2e-4) and got["h9"] == pytest.approx(0.15 * 0.85**9, abs=2e-4)


def test_verdicts_through_links_match_a_dense_solution(spark, salt=2):
    import numpy as np

    r = random.Random(3)
    names = ["Spam.net", "x.net", "u@good.org:8080", "b.org"] + [f"h{k}.com" for k in range(14)]
    rows, links = [], defaultdict(int)
    for k in range(160):
        a = k % len(names)
        to = [r.randrange(len(names)) for _ in range(r.randint(0, 3))]
        path = r.choice(["/fr/", "/"]) if "org" in names[a] else "/"
        rows.append((k, f"http://{names[a]}{path}{k}", "".join(f'<a href="https://{names[b]}/p">' for b in to)))
        for b in to:
            if a != b:
                links[a, b] += 1
    judged = [urlgraph_rule(names[a].lower(), path) for a, path in ((k % len(names), rows[k][1].split(names[k % len(names)], 1)[1]) for k in range(160))]
    good, bad = (np.array([np.mean([judged[k] == v for k in range(160) if k % len(names) == a]) for a in range(len(names))]) for v in ("allow", "block"))
    m = np.array([[links.get((a, b), 0) for b in range(len(names))] for a in range(len(names))], float)

    def solve(weights, seed):
        out = weights.sum(axis=1, keepdims=True)
        return np.linalg.solve(np.eye(len(seed)) - 0.85 * np.divide(weights, out, out=np.zeros_like(weights), where=out > 0).T, 0.15 * seed)

    trust, distrust = solve(m, good), solve(m.T, bad)
    want = {k: judged[k] or ("block" if distrust[k % len(names)] >= urlgraph.MIN_DISTRUST and distrust[k % len(names)] > trust[k % len(names)] else "allow") for k in range(160)}
    old, urlgraph.SALT_EDGES = urlgraph.SALT_EDGES, salt
    try:
        got = urlgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    finally:
        urlgraph.SALT_EDGES = old
    assert all(abs((x.trust or 0) - trust[x.page_id % len(names)]) < 1e-6 and abs((x.distrust or 0) - distrust[x.page_id % len(names)]) < 1e-6 for x in got)
    assert {x.page_id: x.verdict for x in got} == want
    assert {want[k] for k in range(160) if judged[k] is None} == {"allow", "block"}


def urlgraph_rule(host, path):
    fits = [(len(h + p), v) for v, h, p in urlgraph.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1] if fits else None


def turns_of(text):
    return re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)


def cheapest(roles):
    cost = {chat.START: 0.0}
    for role in roles:
        new = {}
        for a, c in cost.items():
            for x, b, merged, way in chat.CHOICES:
                if x == a:
                    new[b] = min(new.get(b, 1e9), c + chat.role_cost(role, b) + chat.MERGE * merged + chat.INSERT * len(way))
        cost = new
    return min(c + chat.END[s] for s, c in cost.items())


@pytest.mark.parametrize("ranges", ["1", "9"])
def test_role_repair(spark, ranges):
    r = random.Random(4)
    rows = []
    for conv in range(25):
        for t in range(1 if conv == 0 else r.randint(1, 9)):
            rows.append((conv, t, r.choice(["user", "assistant", "system", "Tool", None, "USER "]), r.choice([f"t{conv}.{t}", None]), "z"))
    rows += [(99, t, r.choice(["user", "assistant"]), f"x{t}", "z") for t in range(3000)]
    rows += [(None, 0, "user", "anon", "z"), (98, 1, "user", "twin", "z"), (98, 1, "user", "twin", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = chat.repair(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    by = defaultdict(list)
    for x in got:
        by[x.conv_id].append(x)
    given = defaultdict(list)
    for conv, t, role, text, _ in rows:
        given[conv].append((t, chat._known(role)))
    for conv, own in by.items():
        own.sort(key=lambda x: x.turn)
        text = "".join(x.piece for x in own)
        found = turns_of(text)
        assert "".join(chat.render(*t) for t in found) == text
        seq = [role for role, _ in found]
        seq = seq[1:] if seq[0] == "system" else seq
        assert seq == ["user", "assistant"] * (len(seq) // 2) and seq
        spent = sum(chat.INSERT * len(x.inserted.split(",")) for x in own if x.inserted) + sum(chat.MERGE for x in own if "merge" in x.action)
        spent += sum(chat.role_cost(role, chat.ROLES.index(x.role)) for x, (_, role) in zip(own, sorted(given[conv], key=lambda v: v[0]), strict=True))
        assert abs(spent - cheapest([role for _, role in sorted(given[conv], key=lambda v: v[0])])) < 1e-9
    assert chat.repair(df.limit(0)).count() == 0


def legal(roles):
    rest = roles[1:] if roles[:1] == ["system"] else roles
    return len(rest) % 2 == 0 and rest == ["user", "assistant"] * (len(rest) // 2) and (bool(rest) or not roles)


def cheapest_by_listing(roles):
    """Least cost over all repairs of a few turns, listed one by one, with prices of its own; legality is judged on the result alone."""
    price = {("user", "assistant"): 4, ("assistant", "user"): 4, ("system", "user"): 2, ("system", "assistant"): 5, ("user", "system"): 4, ("assistant", "system"): 5,
             (None, "system"): 4, (None, "user"): 2, (None, "assistant"): 2.5}
    names = ["system", "user", "assistant"]
    paddings = [list(p) for n in range(3) for p in itertools.product(["user", "assistant"], repeat=n)]
    best = float("inf")

    def go(k, out, cost):
        nonlocal best
        if cost >= best:
            return
        if k == len(roles):
            for tail in paddings:
                if legal(out + tail):
                    best = min(best, cost + 3 * len(tail))
            return
        for new in names:
            c = 0 if new == roles[k] else price[roles[k], new]
            if k and out[-1] == new:
                go(k + 1, out, cost + c + 1)
            for way in paddings:
                go(k + 1, out + way + [new], cost + c + 3 * len(way))

    go(0, [], 0)
    return best


def test_role_repair_against_all_repairs(spark):
    kinds = ["user", "assistant", "system", None]
    convs = [c for n in (1, 2, 3) for c in itertools.product(kinds, repeat=n)]
    convs += [tuple(random.Random(k).choice(kinds) for _ in range(4)) for k in range(25)]
    rows = [(f"c{k}", t, role, "x") for k, c in enumerate(convs) for t, role in enumerate(c)]
    got = defaultdict(list)
    for x in sorted(chat.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect(), key=lambda x: x.turn):
        got[x.conv_id].append(x)
    relabel = {("user", "assistant"): 4, ("assistant", "user"): 4, ("system", "user"): 2, ("system", "assistant"): 5, ("user", "system"): 4, ("assistant", "system"): 5,
               (None, "system"): 4, (None, "user"): 2, (None, "assistant"): 2.5}
    for k, c in enumerate(convs):
        own = got[f"c{k}"]
        spent = sum(3 * len(x.inserted.split(",")) for x in own if x.inserted) + sum("merge" in x.action for x in own)
        spent += sum(relabel[role, x.role] for x, role in zip(own, c, strict=True) if x.role != role)
        assert legal([role for role, _ in turns_of("".join(x.piece for x in own))]) and spent == cheapest_by_listing(list(c)), c


def test_role_repair_does_not_depend_on_ranges(spark):
    r = random.Random(8)
    rows = [(conv, t, r.choice(["user", "assistant", "system", "tool", None]), f"x{t}") for conv, n in ((1, 5), (2, 3000), (3, 7)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = []
    try:
        for ranges in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            got.append(sorted(chat.repair(df).collect(), key=lambda x: (x.conv_id, x.turn)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]
    numbers = [x.out_turn for x in got[1] if x.conv_id == 2]
    assert numbers == sorted(numbers) and numbers[-1] > 1000
