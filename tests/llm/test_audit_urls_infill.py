"""The divergence audit, the URL filter and the fill-in-middle transformation against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from quillon.llm import divergence, infill, url_rules
from quillon.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CLASH = ("n", "p", "q", "value", "rank", "item", "form", "output", "u", "v", "id", "component", "rule", "_url", "_text")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASH})


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_url_filter", "op13_fill_in_middle"])
def test_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(SF, ORACLES[name])


# --- 11


def brute_divergence(rows, top, least):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        count[lang, source].update(found)
        count[lang].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= least]
        p = {}
        for key in [lang, *((lang, s) for s in sources)]:
            total = sum(count[key][t] for t in kept)
            p[key] = {t: 1 + 10**9 * (count[key][t] + 1) // (total + len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            mine = p[lang, s]
            pairs = [(-sum(f(mine[t], p[lang, o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            terms = [(-f(mine[t], p[lang][t]), t.encode(), t) for t in kept if count[lang, s][t] and mine[t] > p[lang][t]]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def audit_rows():
    rng = np.random.default_rng(3)
    vocabulary = [*("w" + "".join(rng.choice(list("abcdé"), 3)) for _ in range(60)), "ÀB", "Zz", "zZ", "𝄞x"]
    rows = []
    for k in range(240):
        weights = rng.dirichlet(np.ones(len(vocabulary)) * 0.2)
        text = " ".join(rng.choice(vocabulary, int(rng.integers(0, 40)), p=weights))
        rows.append((text, ["en", "de", "xx"][k % 3], f"s{int(rng.integers(0, 9)) if k % 5 else 0}"))
    rows += [(None, "en", "s1"), ("", None, None), ("1 2 3", "qq", "a"), ("--", "qq", "b"), ("once", "rr", "a"), ("word " * 50_000, "en", "s0")]
    rows += [("copy of a row", "en", "s2")] * 3 + [("tie one two", "ty", s) for s in "abc"] * 2
    return rows


@pytest.mark.parametrize(("top", "block"), [(200, 256), (3, 2)])
def test_op11_equals_brute_force(spark, monkeypatch, top, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = audit_rows()
    df = clashing(spark.createDataFrame(rows, "text string, lang string, source string")).repartition(5)
    got = divergence.divergence_audit(df, top=top).collect()
    assert sorted(map(tuple, got)) == brute_divergence(rows, top, 3)


def test_op11_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    got = divergence.divergence_audit(empty)
    assert got.count() == 0 and got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_op11_second_wave_reads_few_postings(spark):
    """The bound leaves out what cannot enter: buckets strictly below the threshold are not evaluated."""
    rng = np.random.default_rng(8)
    common = [f"c{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows = [(" ".join(rng.choice(common, 400)), "en", f"s{k % 3}") for k in range(60)]
    rows += [("peak " * 3000, "en", "s0")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = [r for r in divergence.divergence_audit(df, top=1).collect() if r["part"] == "term" and r["source"] == "s0"]
    assert [r["item"] for r in got] == ["peak"] and sorted(map(tuple, divergence.divergence_audit(df, top=1).collect())) == brute_divergence(rows, 1, 3)


def test_op11_counts_beyond_64_bits_of_product(spark):
    """A thousand million times the count leaves 64 bits; decimals do not."""
    row = spark.createDataFrame([(12_000_000_000, 13_000_000_000)], "n long, total long").select(divergence._probability(F.col("n"), F.col("total")).alias("p")).head()
    assert row["p"] == 1 + 10**9 * 12_000_000_001 // 13_000_000_000


# --- 12


def brute_urls(pages, redirects=()):
    upper = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def parts(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        return (m[1].translate(upper), m[2]) if m else ("", "")

    def rule(u):
        host, path = parts(u)
        fits = [(h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda x: len(x[0]), default=(None, None))

    def usual(u):
        host, path = parts(u)
        if not host:
            return u
        host = re.sub(r":(80|443)$", "", re.sub(r"^(www|m)\.([^.]+\.)", r"\2", host))
        path = re.sub(r"\.html?$", "", re.sub(r"/(index\.html?)?$", "", path))
        asked = re.match(r"(?s).*?://[^?#]*\?([^#]*)", u)
        kept = [x for x in (asked[1].split("&") if asked else []) if x and not re.match(r"(utm_[a-z]*|ref)(=|$)", x)]
        return f"https://{host}{path}" + ("?" + "&".join(kept) if kept else "")

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    edges = list(redirects)
    for _, u, links in pages:
        edges += [(u, v) for v in links if u]
    nodes = {x for e in edges for x in e} | {u for _, u, _ in pages if u}
    edges += [(x, usual(x)) for x in nodes]
    for a, b in edges:
        root[find(a)] = find(b)
    seen = defaultdict(set)
    for x in list(root):
        seen[find(x)].add(rule(x)[1])
    out = {}
    for k, u, _ in pages:
        host, path = parts(u)
        name, verdict = rule(u)
        if verdict is None:
            of = seen[find(u)] if u else set()
            verdict = "block" if "block" in of and "allow" not in of else "allow"
        out[k] = (host, path, name, verdict)
    return out


def test_op12_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    hosts = ["a.example.org", "b.example.net", "www.example.com", "m.c.example.com", "D.Example.ORG", "e.org:443", "f.net"]
    url = lambda: f"http{'s' if rng.integers(2) else ''}://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{int(rng.integers(0, 40))}{rng.choice(['', '/', '.html', '#top', '?utm_source=x', '?page=2&ref=y', '?q=1'])}"
    pages, html = [], {}
    for k in range(160):
        u, v = url(), url()
        style = int(rng.integers(0, 8))
        links = [v] if style < 4 else []
        html[k] = ["<head><link rel=\"canonical\" href=\"{}\">", "<LINK href='{}' REL='canonical'/>", "<meta http-equiv=\"refresh\" content=\"0; URL='{}'\">", "<meta content=\"5;url={}\" http-equiv=Refresh>", "<link rel=\"stylesheet\" href=\"{}\">", "<p>canonical {}</p>", "", None][style]
        html[k] = html[k] and html[k].replace("{}", v.replace("&", "&amp;"))
        pages.append((k, u, links))
    chain = [f"https://chain.org/x{k}" for k in range(30)]
    pages += [(200 + k, c, [chain[k + 1]] if k < 29 else ["https://z.net/es/1"]) for k, c in enumerate(chain)]
    html |= {200 + k: f'<link rel="canonical" href="{"x%d" % (k + 1) if k < 29 else "//z.net/es/1"}">' for k in range(30)}
    extra = [(300, None, []), (301, "", []), (302, "no scheme", []), (303, "://x", []), (304, "http://", []), (305, "https://loop.org/a", ["https://loop.org/b"]), (306, "https://loop.org/b", ["https://loop.org/a"]), (307, "https://loop.org/a", []), (308, "https://to.org/1", []), (309, "https://to.org/2", []), (310, "https://long.org/" + "y" * 200_000, [])]
    html |= {305: '<link rel="canonical" href="/b">', 306: '<link rel=canonical href=/a >', 310: "<p>" * 100_000}
    pages += extra
    redirects = [("https://to.org/1", "http://f.net/fr/9"), ("https://to.org/2", "http://f.net/fr/8"), ("https://to.org/2", "https://www.example.com/en/8")]
    df = clashing(spark.createDataFrame([(k, u, html.get(k)) for k, u, _ in pages], "page_id long, url string, html string"))
    got = url_rules.filter_urls(df, redirects=spark.createDataFrame(redirects, "from_url string, to_url string")).collect()
    want = brute_urls(pages, redirects)
    assert len(got) == len(pages) and {r["page_id"]: tuple(r)[1:] for r in got} == want
    assert want[200][3] == "block" and want[308][3] == "block" and want[309][3] == "allow"
    assert sum(v[2] is None and v[3] == "block" for v in want.values()) > 40


def test_op12_longest_rule_and_empty_table(spark):
    urls = {"http://example.com/en/": "block", "http://WWW.example.com/en/x": "allow", "https://x.www.example.com/en/": "allow", "http://notexample.com/en/": "allow", "http://example.com.net/fr/": "block", "ftp://a.net/es/?x": "block", "http://a.net?/es/": "allow", "http://com/": "allow"}
    df = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string")
    rows = url_rules.filter_urls(df).orderBy("page_id").collect()
    assert [r["verdict"] for r in rows] == list(urls.values())
    assert [r["rule"] for r in rows][:4] == ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/"]
    assert url_rules.filter_urls(df.limit(0)).count() == 0
    plan = url_rules.filter_urls(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 13


def cut(doc_id, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in infill.MARKERS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_op13_equals_python(spark):
    rng = np.random.default_rng(6)
    odd = [None, "", "a", "\x01", "\x02", "\x01\x02d\x02e\x01", "<P", "<S>x", "a<M>", "$1 \\ \r\n ", "𝄞é́" * 50, "x" * 1_200_000, "<P<S<M" * 9]
    rows = [(k, odd[k % len(odd)]) for k in range(130)]
    rows += [(k, "".join(rng.choice(list("ab\x01\x02ed<PSM é𝄞\n"), int(rng.integers(0, 60))))) for k in range(1000, 1400)]
    rows += [(7, "repeat"), (7, "repeat"), (7, "other"), (None, "no id at all")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    got = infill.fill_in_middle(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((k, *cut(k, t))) for k, t in rows)
    digests = {(r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in infill.infill_digests(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert digests == {(k, sha(cut(k, t)[4]), sha(t or "")) for k, t in rows}
    assert infill.fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["word", "line"])
def test_op13_other_units(spark, unit):
    texts = ["one two  three\nfour \x01five\x02\n\nsix", "  lead\n", "", "a\nb\nc"] * 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ends = {"word": r"\S+\s*|\s+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    for r in infill.fill_in_middle(df, unit=unit, percent=100).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect():
        text = texts[r["doc_id"]]
        parts = re.findall(ends, text)
        assert r["n"] == len(parts) and r["back"] == text
        if r["form"] != "plain":
            places = {len("".join(parts[:k])) for k in range(len(parts) + 1)}
            assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= places
