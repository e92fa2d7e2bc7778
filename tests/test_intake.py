"""Rules of pages, claims, calls, queue moves and backups on small inputs."""

from __future__ import annotations

import random
import subprocess
import sys
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from orrery.functions import robots
from orrery.operators import enrichment, intake, listing, monitor, prefix
from orrery.sources import feeds, sitemaps


def test_robots(spark):
    rows = [("a", "User-agent: *\nDisallow: /x\n", "/x/1"), ("b", "User-agent: *\nDisallow: /x\n", "/y"), ("c", None, "/x"), ("d", "  ", "/x"), ("e", "User-agent: other\nDisallow: /\n", "/x")]
    t = spark.createDataFrame(rows, "id string, text string, path string")
    got = {r.id: r.ok for r in t.select("id", robots.allowed(robots.rules(F.col("text")), F.col("path")).alias("ok")).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": True, "e": True}


def test_robots_like_the_standard_parser(spark):
    """The standard library's parser as the judge, on files without a blank line inside a group."""
    rng, files = random.Random(2), ["# only a comment\nSitemap: https://a/1.xml\nsitemap : https://a/2.xml", "Disallow: /before\nUser-agent: bot\nuser-agent: *\nDisallow: # nothing\nDisallow: /a"]
    for _ in range(40):
        groups = ["\n".join([f"{rng.choice(('User-agent', 'user-AGENT'))}: {a}" for a in rng.sample(("*", "bot", "Other", "spider"), rng.randint(1, 2))] + [f"{rng.choice(('Allow', 'Disallow', 'disallow'))}: {rng.choice(('/', '/a', '/a/b', '/c', ''))}{rng.choice(('', ' # why'))}" for _ in range(rng.randint(1, 4))]) for _ in range(rng.randint(0, 3))]
        files.append("\r\n\r\n".join(groups) if rng.random() < 0.3 else "\n\n".join(groups))
    paths = ("/", "/a", "/a/b/c", "/c?x", "/d")
    for agent in ("*", "bot/1.0", "spider"):
        t = spark.createDataFrame(list(enumerate(files)), "id int, text string").select("id", robots.rules(F.col("text"), agent).alias("r"), robots.sitemaps(F.col("text")).alias("m"))
        got = {r.id: r for r in t.select("id", "m", *[robots.allowed(F.col("r"), F.lit(p)).alias(p) for p in paths]).collect()}
        for i, text in enumerate(files):
            judge = RobotFileParser()
            judge.parse(text.splitlines())
            assert [got[i][p] for p in paths] == [judge.can_fetch(agent, p) for p in paths], (agent, text)
        assert got[0].m == ["https://a/1.xml", "https://a/2.xml"]


def test_first_json_object(spark):
    cases = {'x {"a": "}{", "b": [1]} y': '{"a": "}{", "b": [1]}', '```json\n{"a": 1}\n```': '{"a": 1}', "{not} then {\"b\": 2} {\"c\": 3}": '{"b": 2}', "[{\"d\": 4}]": '{"d": 4}', "no {object": None, "": None, '{"open": {"e": 5}': '{"e": 5}'}
    t = spark.createDataFrame([*[(k,) for k in cases], (None,)], "x string")
    assert {r.x: r.y for r in t.select("x", enrichment.extract_json(F.col("x")).alias("y")).collect()} == {**cases, None: None}


def test_sitemaps_end_at_cycles_and_limits(spark):
    loc = lambda *urls: "".join(f"<url><loc>{u}</loc></url>" for u in urls)
    files = [("d", "i", f"<sitemapindex>{loc('i', 'a', 'j')}</sitemapindex>"), ("d", "j", f"<sitemapindex>{loc('i', 'b', 'deep')}</sitemapindex>"), ("d", "a", f"<urlset>{loc('p1', 'p2', 'x.JPG?v')}</urlset>"), ("d", "b", f"<urlset>{loc('p2', 'p3&amp;q')}</urlset>"), ("d", "deep", f"<sitemapindex>{loc('c')}</sitemapindex>"), ("d", "c", f"<urlset>{loc('p4')}</urlset>"), ("e", "r", "<html>no map</html>"), ("f", "r", None), ("g", "r", f"<sitemapindex>{loc(*[f'm{k:03}' for k in range(80)])}</sitemapindex>")]
    files += [("g", f"m{k:03}", f"<urlset>{loc(*[f'{k}/{j}' for j in range(30)])}</urlset>") for k in range(80)]
    t = spark.createDataFrame(files, "domain string, url string, xml string")
    roots = spark.createDataFrame([("d", "i"), ("e", "r"), ("f", "r"), ("g", "r"), ("h", "none")], "domain string, url string")
    got = {(r.domain, r.url, r.depth) for r in sitemaps.page_urls(t, roots).filter("domain = 'd'").collect()}
    assert got == {("d", "p1", 1), ("d", "p2", 1), ("d", "p3&q", 2), ("d", "p4", 3)}
    assert {r.domain: r.sku_estimate for r in sitemaps.sku_estimates(t, roots).collect()} == {"d": 4, "e": None, "f": None, "g": 1000, "h": None}
    assert {r.domain: r.sku_estimate for r in sitemaps.sku_estimates(t, roots, pages=5000).collect()}["g"] == 50 * 30


def test_products_in_odd_structured_data(spark):
    ld = lambda x: f'<script type="application/ld+json">{x}</script>'
    deep = '{"@type":"Product","name":"deep one"}'
    for _ in range(5):
        deep = f'{{"x":[{deep}]}}'
    rows = [("https://a/1", ld(deep)), ("https://a/2", ld('{"@type":"Product","name":{"x":1},"sku":5,"offers":"none","image":"rel.png"}') + "<h1>RTM-06</h1>"), ("https://a/three", None), ("https://a/4", ld("") + ld('{"@type":"Product","name":"A\tb  c","brand":["x"]}')), ("https://a/5", "<h1>Free</h1><i itemprop='price' content='0'>₹ 1,20,000</i>")]
    got = {r.url[-1]: r for r in feeds.json_ld_products(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert (got["1"].title, got["1"].structured) == ("deep one", True)
    assert (got["2"].title, got["2"].sku, got["2"].price_inr, got["2"].image_url) == (None, "5", None, None)
    assert (got["e"].title, got["e"].sku, got["e"].structured) == (None, "three", False)
    assert (got["4"].title, got["4"].brand, got["5"].title, got["5"].price_inr) == ("A b  c", None, "Free", None)


def test_sites_of_brands(spark):
    page = lambda *urls: "".join(f'<a href="{u}">' for u in urls)
    rows = [("Acme Stone", page("https://www.facebook.com/a", "http://other.in", "https://www.acme.co.in/x")), ("Zed", page("https://other.in/", "https://second.in/")), ("None", page("https://t.me/x")), ("Gone", None)]
    t = spark.createDataFrame(rows, "brand string, html string")
    got = [r.d for r in t.select(intake.resolve_site(F.col("html"), F.col("brand")).alias("d")).collect()]
    assert got == ["acme.co.in", "other.in", None, None]


def test_phone_digits(spark):
    cases = {"+91 98765-43210": "9876543210", "09876543210": "9876543210", "1800 123 4567": "18001234567", "022-12345678": "2212345678", "12345": None, "": None}
    t = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.y for r in t.select("x", intake.phone_digits(F.col("x")).alias("y")).collect()} == cases


def test_companies_are_merged_in_one_pass(spark):
    """Channels of all pages, fields of the first page that has them; what found costs is paid once."""
    fields = ("legal_name", "gstin", "cin", "address", "city", "state", "pincode", "year_established")
    page = lambda url, phones, emails, **x: (url, phones, emails, *[x.get(f) for f in fields])
    rows = [page("https://www.a.in/2", ["2", "1"], ["x@a.in"], legal_name="late", city="Pune"), page("https://a.in/1", ["1", "3"], None, legal_name="A"), page("https://a.in/0", [], []), page("https://b.in/", None, None, pincode="411001"), page("https://b.in/", None, [])]
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    shape = "url string, phones array<string>, emails array<string>, " + ", ".join(f"{f} string" for f in fields)
    found = spark.createDataFrame(rows, shape)
    got = {r.domain: r for r in intake.merged_company(found.mapInArrow(counted, found.schema)).collect()}
    assert runs.value == len(rows) and set(got) == {"a.in", "b.in"}
    a, b = got["a.in"], got["b.in"]
    assert (a.pages, a.legal_name, a.city, a.phones, a.emails) == (3, "A", "Pune", ["1", "2", "3"], ["x@a.in"])
    assert (b.pages, b.legal_name, b.pincode, b.phones, b.emails) == (2, None, "411001", None, None)


def test_suppliers_are_dealt_before_pages_are_read(spark, tmp_path):
    spark.createDataFrame([(k, f"S{k}", 1, 0.0) for k in range(40)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert intake.extract_company(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_company_page(spark):
    html = """<script type="application/ld+json">{"x":[{"@type":"Store","name":"Acme","email":"HELLO@acme.in","address":[{"addressLocality":"Pune","postalCode":"41"}],"logo":{"url":"l.png"},"foundingDate":"1990-01-01","sameAs":"https://twitter.com/a"}]}</script>
    <script type="application/ld+json">{broken</script><script>var n = 9999999999;</script>
    contact person Mr. Shah 9876500000, office 9876511111, (022) 12345678, x@third.com U12345MH2001PTC123456 Pin Code: 400001 estd. 1850"""
    r = intake.company(spark.createDataFrame([("https://acme.in/c", html)], "url string, html string")).first()
    assert (r.legal_name, r.city, r.cin, r.pincode, r.year_established, r.social) == ("Acme", "Pune", "U12345MH2001PTC123456", "400001", "1990", {"twitter": "https://twitter.com/a"})
    assert r.phones == ["2212345678", "9876511111"] and r.emails == ["hello@acme.in"]
    empty = intake.company(spark.createDataFrame([("https://a.in", None), ("https://b.in", "")], "url string, html string")).collect()
    assert all((r.phones or []) == [] and r.legal_name is None for r in empty)


def test_claims(spark):
    fields = F.create_map(F.lit("f1"), F.lit("Oak panel 18 mm"), F.lit("f2"), F.lit("outdoor"))
    check = lambda text, *cites: spark.range(1).select(enrichment.claim_faults(F.lit(text), F.array(*[F.lit(c) for c in cites]).cast("array<string>"), fields, F.lit("acme.in")).alias("x")).first().x
    assert check("Oak panel with a calm grain", "f1") == []
    assert check("Suitable for outdoor decks", "f2") == []
    assert check("A waterproof panel", "f1") == ["banned"]
    assert check("The oak panel product", "f1") == ["restatement"]
    assert check("Sold by ACME.in with care", "f1") == ["plumbing"]
    assert check("Meets IS 18 rules", "f1") == ["standard"]
    assert check("Looks like walnut", "img1") == [] and check("Very strong", "img1") == ["image"]


def test_text_pass_fills_only_nulls(spark):
    rows = [(1, "Tile 600x600 mm Glossy White", "tile", None, "Matte", None), (2, None, "tile", None, None, None)]
    t = spark.createDataFrame(rows, "id long, title string, category string, size_mm string, finish string, description string")
    a, b = enrichment.text_pass(t).orderBy("id").collect()
    assert (a.size_mm, a.finish, a.color) == ("600x600", "Matte", "White") and a.filled == ["size_mm", "color", "color_family"]
    assert '"basis":"derived"' in a.provenance and b.filled == []


def test_listing_filters(spark):
    p = spark.createDataFrame([(1, "x", 5.0, "Wall", True), (2, "y", None, "Floor", False), (3, "x", 9.0, "Wall", None)], "id long, brand string, price_inr double, family string, publish_ready boolean")
    ids = lambda **f: [r.id for r in p.filter(listing.filters(**f)).orderBy("id").collect()]
    assert ids() == [1, 2, 3] and ids(priced=True) == [1, 3] and ids(priced=False) == [2] and ids(min_price=6) == [3] and ids(max_price=6) == [1]
    assert ids(family="Wall", brand="x") == [1, 3] and ids(publish_ready=False) == [2]


def test_queue_moves(spark):
    shape = "id long, stage string, target string, status string, attempts int, max_attempts int, priority int, updated_at timestamp_ntz"
    at = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    rows = [(1, "h", "a", "pending", 1, 3, 0), (2, "h", "b", "running", 1, 3, 5), (3, "h", "c", "failed", 3, 3, 0), (4, "e", "a", "failed", 3, 3, 0)]
    q = spark.createDataFrame(rows, shape.replace(", updated_at timestamp_ntz", "")).withColumn("updated_at", F.when(F.col("id") == 2, F.lit("2024-01-01 11:00:00")).otherwise("2024-01-01 11:59:00").cast("timestamp_ntz"))
    status = lambda t: {r.id: r.status for r in t.collect()}
    assert status(monitor.claimed(q, at, 1)) == {1: "pending", 2: "running", 3: "failed", 4: "failed"}
    assert status(monitor.claimed(q, at, 2))[1] == "running"
    assert status(monitor.requeued(q, at))[2] == "pending" and status(monitor.revived(q, "h")) == {1: "pending", 2: "running", 3: "pending", 4: "failed"}
    new = spark.createDataFrame([("h", "a", 9, 4), ("h", "z", 9, 4), ("h", "z", 9, 4)], "stage string, target string, priority int, max_attempts int")
    assert {(r.target, r.attempts) for r in monitor.enqueue(q, new).filter("stage = 'h'").collect()} == {("a", 1), ("b", 1), ("c", 3), ("z", 0)}
    assert {(r.target, r.attempts) for r in monitor.enqueue(q, new, reset=True).filter("stage = 'h'").collect()} == {("a", 0), ("b", 1), ("c", 3), ("z", 0)}
    assert status(monitor.completed(q, spark.createDataFrame([(2, None)], "id long, result string")))[2] == "done"


def test_running_sum(spark):
    rows = [(k, i, (i * 7) % 5) for k in ("a", "b", None) for i in range(50)]
    got = prefix.running_sum(spark.createDataFrame(rows, "k string, i long, v long").repartition(5), ["k"], ["i"], "v", "s").collect()
    assert len(got) == 150 and all(r.s == sum((j * 7) % 5 for j in range(r.i + 1)) for r in got)


def test_backup_notices_a_changed_row(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, s string")
    enrichment.dump({"a": a}, f"file://{tmp_path}/b")
    back = enrichment.restore(spark, f"file://{tmp_path}/b", ["a"])
    assert enrichment.compared({"a": a}, back).first().equal
    assert not enrichment.compared({"a": a.withColumn("s", F.lit("y"))}, back).first().equal


@pytest.mark.parametrize("kept", ["nothing", "an empty folder"])
def test_entry_without_the_llm_folders(tmp_path, kept):
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for source in [root / "__spark_entry__.py", *root.glob("orrery/**/*.py")]:
        if "llm" not in source.parts:
            to = tmp_path / source.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(source.read_bytes())
    if kept != "nothing":
        (tmp_path / "orrery/llm/__pycache__").mkdir(parents=True)
        (tmp_path / "corpus_pipeline.py").write_bytes(b"from orrery.llm import language_id\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) == set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_repairs(spark):
    from orrery.operators.enrichment import repaired

    def probe(domain):
        if domain == "gone":
            raise OSError("no route")
        return {"status": "ambiguous"} if domain == "vague" else {"status": "classified", "tier": "shopify"}

    jobs = spark.createDataFrame([(1, "moved", 0, 3), (2, "same", 0, 3), (3, "gone", 0, 3), (4, "vague", 2, 3), (5, "new", 0, 3), (6, "moved", 1, 3)], "id long, target string, attempts int, max_attempts int")
    registry = spark.createDataFrame([("moved", "jsonld"), ("same", "shopify"), ("gone", "jsonld"), ("vague", None)], "domain string, scrape_tier string")
    got = {r.id: (r.old_tier, r.new_tier, r.reclassified, r.status, r.attempts, r.error) for r in repaired(jobs, registry, probe).collect()}
    assert got == {
        1: ("jsonld", "shopify", True, "done", 0, None),
        2: ("shopify", "shopify", False, "done", 0, None),
        3: ("jsonld", None, False, "pending", 1, "no route"),
        4: (None, None, False, "failed", 3, "no tier: ambiguous"),
        5: (None, "shopify", False, "done", 0, None),
        6: ("jsonld", "shopify", True, "done", 1, None),
    }
    assert repaired(jobs.limit(0), registry, probe).count() == 0
