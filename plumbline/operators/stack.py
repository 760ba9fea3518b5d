"""What sites are built with: evidence from pages and host headers, weighed per technology, hosting and way of rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.html import attribute, body_of, decoded, tags, visible

# Marks in the html, mount points, and the evidence for each technology and host (what is looked at, how, for what, weight).
MARKS = {
    "__NEXT_DATA__": """id=["']__NEXT_DATA__["']""", "__NUXT__": r"""window\.__NUXT__|id=["']__nuxt["']""", "___gatsby": """id=["']___gatsby["']""", "astro-island": "astro-island", "data-sveltekit": "data-sveltekit", "__remixContext": "__remixContext",
    "ng-version": r"\bng-version=", "data-reactroot": "data-reactroot", "data-v-": r"\bdata-v-[0-9a-f]{6,}", "data-wf-page": "data-wf-page=", "Shopify.theme": r"Shopify\.theme|cdn\.shopify\.com", "wp-block": "wp-block-|wp-content/",
}
MOUNTS = ("root", "app", "__next", "__nuxt", "___gatsby", "svelte")
TECHNOLOGIES = {
    ("WordPress", "cms"): (("generator", "wordpress", 3), ("asset", "/wp-content/|/wp-includes/", 3), ("mark", "wp-block", 1)),
    ("Shopify", "cms"): (("asset or mark", r"cdn\.shopify\.com", 3), ("generator", "shopify", 3)),
    ("Wix", "builder"): (("generator", r"wix\.com", 3), ("asset", r"parastorage\.com|wixstatic\.com", 3)),
    ("Squarespace", "builder"): (("generator", "squarespace", 3), ("asset", r"squarespace\.com|squarespace-cdn\.com", 2)),
    ("Webflow", "builder"): (("generator", "webflow", 3), ("mark", "data-wf-page", 3), ("asset", r"website-files\.com", 2)),
    ("Ghost", "cms"): (("generator", "^ghost", 3),),
    ("Next.js", "framework"): (("mark", "__NEXT_DATA__", 3), ("script", "/_next/static/", 3), ("x-powered-by", r"next\.js", 3)),
    ("Nuxt", "framework"): (("mark", "__NUXT__", 3), ("script", "/_nuxt/", 3)),
    ("Gatsby", "static-generator"): (("generator", "gatsby", 3), ("mark", "___gatsby", 3)),
    ("Astro", "static-generator"): (("generator", "astro", 3), ("mark", "astro-island", 3), ("asset", "/_astro/", 3)),
    ("SvelteKit", "framework"): (("script", "/_app/immutable/", 3), ("mark", "data-sveltekit", 3)),
    ("Remix", "framework"): (("mark", "__remixContext", 3),),
    ("Angular", "framework"): (("mark", "ng-version", 3),),
    ("Vue", "framework"): (("mark", "data-v-", 2), ("script", r"vue\.min\.js|vue\.global|/vue\.", 2), ("mount", "app", 1)),
    ("React", "framework"): (("mark", "data-reactroot", 3), ("script", r"react\.production|react-dom|/static/js/main\.", 2), ("mount", "root", 1)),
    ("Vite build", "tooling"): (("script", r"/assets/index-[\w-]{6,}\.js", 2),),
    ("Hugo", "static-generator"): (("generator", "^hugo", 3),),
    ("Jekyll", "static-generator"): (("generator", "jekyll", 3),),
    ("Eleventy", "static-generator"): (("generator", "eleventy|^11ty", 3),),
    ("Docusaurus", "static-generator"): (("generator", "docusaurus", 3),),
    ("MkDocs", "static-generator"): (("generator", "mkdocs", 3),),
    ("Hexo", "static-generator"): (("generator", "hexo", 3),),
    ("jQuery", "library"): (("script", "jquery", 3),),
    ("Bootstrap", "library"): (("asset", "bootstrap", 3),),
}
HOSTS = {
    "GitHub Pages": (("server", r"github\.com", 3), ("x-github-request-id", ".", 3)),
    "Netlify": (("server", "netlify", 3), ("x-nf-request-id", ".", 3)),
    "Vercel": (("server", "vercel", 3), ("x-vercel-id", ".", 3)),
    "Cloudflare (CDN or Pages)": (("server", "cloudflare", 2), ("cf-ray", ".", 2)),
    "AWS (CloudFront / S3)": (("x-amz-cf-id", ".", 3), ("via", "cloudfront", 3), ("server", "amazons3", 3)),
    "Fly.io": (("fly-request-id", ".", 3),),
    "nginx": (("server", "nginx", 1),),
    "Apache": (("server", "apache", 1),),
}
#: Hosts that say little beside any other, frameworks that deliver whole pages, technologies that a bare mount point does not prove.
PLAIN_HOSTS, PRERENDERING, NOT_BY_MOUNT = ("nginx", "Apache"), ("Next.js", "Nuxt", "SvelteKit", "Remix", "Astro", "Gatsby"), ("React", "Vue")
LABELS = {
    "client-rendered": "Renders in the browser (content appears after JavaScript runs)", "mixed": "Some pages render in the browser", "platform-rendered": "Rendered by the platform on the server", "pre-rendered": "Pre-rendered HTML (framework)",
    "static-generated": "Generated static HTML", "unknown-framework-rendering": "JavaScript framework (rendering unclear)", "static-html": "Plain HTML",
}
HTML_SEARCHED = 400_000

_HEADERS = sorted({what for rules in (*HOSTS.values(), *TECHNOLOGIES.values()) for what, _, _ in rules} - {"generator", "asset", "script", "mark", "mount", "asset or mark"})
#: Every rule in order: technology or host, kind, what, pattern, weight.
RULES = [(name, kind, *r) for (name, kind), rules in TECHNOLOGIES.items() for r in rules] + [(name, "hosting", *r) for name, rules in HOSTS.items() for r in rules]


def signals(pages: DataFrame) -> DataFrame:
    """What each page (site_id, page_id, html, and headers if there are any) shows of its making; pages of a site count in the order of their ids."""
    headers = F.col("headers") if "headers" in pages.columns else F.lit(None).cast("map<string,string>")
    h = F.substring(F.coalesce("html", F.lit("")), 1, HTML_SEARCHED)
    rows = pages.select("site_id", "page_id", F.coalesce("html", F.lit("")).alias("html"), headers.alias("headers")).withColumns({"all_scripts": tags("html", "script"), "links": tags("html", "link"), "metas": tags("html", "meta")})
    low = lambda xs: F.filter(F.transform(xs, lambda x: F.lower(x)), lambda x: x != "")
    styles = F.filter("links", lambda t: F.lower(attribute(t, "rel")) == "stylesheet")
    mounts = F.filter(F.array(*[F.lit(m) for m in MOUNTS]), lambda m: F.contains(h, F.concat(F.lit('id="'), m, F.lit('"'))) | F.contains(h, F.concat(F.lit("id='"), m, F.lit("'"))))
    named = F.filter("metas", lambda t: F.lower(attribute(t, "name")) == "generator")
    body = visible(body_of("html"))
    rows = rows.select(
        "site_id", "page_id", F.lower(F.trim(F.coalesce(F.try_element_at(F.transform(named, lambda t: decoded(attribute(t, "content"))), F.lit(1)), F.lit("")))).alias("generator"),
        low(F.slice(F.transform(F.filter("all_scripts", lambda t: attribute(t, "src") != ""), lambda t: attribute(t, "src")), 1, 40)).alias("scripts"), low(F.slice(F.transform(styles, lambda t: attribute(t, "href")), 1, 20)).alias("styles"),
        F.array_compact(F.array(*[F.when(h.rlike(p), k) for k, p in MARKS.items()])).alias("marks"), mounts.alias("mounts"), F.size("all_scripts").alias("n_scripts"), body.alias("body"), "headers",
    )
    words = F.size(F.filter(F.split("body", " "), lambda w: w != ""))
    shell = (F.size("mounts") > 0) & (F.length("body") < 100) & (words < 50) & (F.col("n_scripts") >= 1)
    return rows.withColumn("shell", shell).drop("body", "n_scripts")


def _shows(what: str, pattern: str) -> Column:
    """Whether a page shows a piece of evidence."""
    match = lambda xs: F.exists(xs, lambda x: x.rlike(pattern))
    if what == "generator":
        return F.col("generator").rlike(pattern)
    if what == "mark":
        return F.array_contains("marks", pattern)
    if what == "mount":
        return F.array_contains("mounts", pattern)
    if what == "script":
        return match("scripts")
    assets = match("scripts") | match("styles")
    return assets if what == "asset" else assets | F.array_contains("marks", "Shopify.theme")


def evidence(found: DataFrame) -> DataFrame:
    """Every rule that a site's pages or headers meet: ``site_id, rule`` (its place in RULES).

    Rules are tested page by page and a site's hits combine map-side; of a header the first page that has it counts.
    """
    on_pages = F.array_compact(F.array(*[F.when(_shows(what, pattern), F.lit(k)) for k, (_, _, what, pattern, _) in enumerate(RULES) if what not in _HEADERS]))
    hits = found.select("site_id", F.explode(on_pages).alias("rule")).distinct()
    pairs = found.where("headers is not null").select("site_id", "page_id", F.explode("headers").alias("name", "value")).withColumn("name", F.lower("name")).where(F.col("name").isin(*_HEADERS) & (F.coalesce("value", F.lit("")) != ""))
    first = pairs.groupBy("site_id", "name").agg(F.min_by(F.substring("value", 1, 80), "page_id").alias("value"))
    on_headers = F.array_compact(F.array(*[F.when((F.col("name") == what) & F.col("value").rlike(f"(?i){pattern}"), F.lit(k)) for k, (_, _, what, pattern, _) in enumerate(RULES) if what in _HEADERS]))
    return hits.unionByName(first.select("site_id", F.explode(on_headers).alias("rule")))


def technologies(found: DataFrame) -> DataFrame:
    """What each site is built with and hosted on: ``site_id, name, kind, place, confidence, evidence``.

    Weights of the evidence add up: high from 3, medium 2, low 1.  React or Vue by a bare mount point is left out, and so is a plain server beside a telling host.
    """
    rules = found.sparkSession.createDataFrame([(k, n, kind, f"{what}: {p}", w) for k, (n, kind, what, p, w) in enumerate(RULES)], "rule int, name string, kind string, label string, weight int")
    hits = evidence(found).join(F.broadcast(rules), "rule")  # a fixed list of under a hundred rules
    rows = hits.groupBy("site_id", "name", "kind").agg(F.sum("weight").alias("weight"), F.min("rule").alias("place"), F.array_sort(F.collect_list(F.struct("rule", "label"))).alias("labels"))
    telling = rows.where((F.col("kind") == "hosting") & ~F.col("name").isin(*PLAIN_HOSTS)).select("site_id").distinct().withColumn("telling", F.lit(True))
    rows = rows.join(telling.hint("merge"), "site_id", "left")
    weak = (F.col("weight") == 1) & F.col("name").isin(*NOT_BY_MOUNT)
    plain = F.col("name").isin(*PLAIN_HOSTS) & F.coalesce("telling", F.lit(False))
    confidence = F.when(F.col("weight") >= 3, "high").when(F.col("weight") == 2, "medium").otherwise("low")
    return rows.where(~weak & ~plain).select("site_id", "name", "kind", F.col("place").cast("long").alias("place"), confidence.alias("confidence"), F.array_join(F.transform("labels", lambda x: x["label"]), " | ").alias("evidence"))


def detect(found: DataFrame, built: DataFrame | None = None) -> DataFrame:
    """One row for each site: ``site_id, summary, rendering, client_pages, pages, hosting, technologies, pull_requests``."""
    built = technologies(found) if built is None else built
    of = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("place", "name")))), lambda x: x["name"]), " + ")
    kind, named = F.col("kind"), F.col("kind") != "hosting"
    per = built.groupBy("site_id").agg(
        of(named).alias("technologies"), of(~named).alias("hosting"), of(named & ~kind.isin("library", "tooling") & (F.col("confidence") != "low")).alias("lead"),
        F.bool_or(kind.isin("cms", "builder")).alias("platform"), F.bool_or(F.col("name").isin(*PRERENDERING)).alias("prerendering"), F.bool_or(kind == "static-generator").alias("generated"), F.bool_or(kind == "framework").alias("framework"),
    )
    pages = found.groupBy("site_id").agg(F.count("*").alias("pages"), F.count_if("shell").alias("client_pages"))
    rows = pages.join(per.hint("merge"), "site_id", "left")
    rendering = (
        F.when(F.col("client_pages") * 2 >= F.col("pages"), "client-rendered").when(F.col("client_pages") > 0, "mixed").when(F.col("platform"), "platform-rendered").when(F.col("prerendering"), "pre-rendered")
        .when(F.col("generated"), "static-generated").when(F.col("framework"), "unknown-framework-rendering").otherwise("static-html")
    )
    rows = rows.withColumn("rendering", rendering)
    change = F.when(F.col("platform"), "low").when(F.coalesce(F.col("generated") | F.col("framework"), F.lit(False)), "medium").when(F.col("rendering") == "static-html", "high").otherwise("unknown")
    label = F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.col("rendering"))
    lead = F.when(F.coalesce("lead", F.lit("")) != "", F.col("lead")).otherwise(label)
    on = F.when(F.coalesce("hosting", F.lit("")) != "", F.concat(F.lit("on "), F.element_at(F.split("hosting", r" \+ "), 1)))
    summary = F.concat_ws(" · ", lead, on, F.when(F.col("rendering").isin("client-rendered", "mixed"), "renders in the browser"))
    return rows.select("site_id", summary.alias("summary"), "rendering", "client_pages", "pages", F.coalesce("hosting", F.lit("")).alias("hosting"), F.coalesce("technologies", F.lit("")).alias("technologies"), change.alias("pull_requests"))
