"""What pages say in JSON-LD, read as Variant values on the JVM: entity types, questions, market and local signals.

A page's blocks are parsed once; level by level the children of all nodes make the next array, to a fixed depth, within the page's row.  Values of one
kind come in the order of levels, the first 40 of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types that mean a local business, parts of a value that hold questions, depths, and values kept of each kind.
LOCAL_TYPE = (
    "LocalBusiness|Restaurant|Store|Dentist|Hotel|MedicalClinic|Physician|AutoRepair|BeautySalon|HealthClub|Attorney|LegalService|RealEstateAgent|FinancialService|Bakery|CafeOrCoffeeShop|BarOrPub|LodgingBusiness|Pharmacy|Hospital|School"
    "|HomeAndConstructionBusiness|Plumber|Electrician|Locksmith|MovingCompany|HairSalon|DaySpa|VeterinaryCare|AccountingService|InsuranceAgency|TravelAgency|AutoDealer|GroceryStore|ShoppingCenter"
)
QUESTION_PARTS = ("@graph", "mainEntity", "hasPart", "itemListElement", "item")
ENTITY_DEPTH, DEPTH, KEPT = 7, 8, 40
SCHEMA_PREFIX = r"^(?i)(https?://(www\.)?schema\.org/|schema:)"


def _at(x: str, *keys: str) -> str:
    """SQL of a part of a variant."""
    return f"try_variant_get({x}, '${''.join(f'[{chr(34)}{k}{chr(34)}]' for k in keys)}', 'variant')"


def _text(x: str) -> str:
    """SQL of a variant that is a string, trimmed; null for any other value or an empty one."""
    return f"nullif(if(schema_of_variant({x}) = 'STRING', trim(cast({x} as string)), null), '')"


_ARRAY, _OBJECT = "try_cast(x as array<variant>)", "try_cast(x as map<string,variant>)"
_CHILDREN = f"coalesce(map_values({_OBJECT}), {_ARRAY}, array())"
_GRAPH = f"coalesce({_ARRAY}, array({_at('x', '@graph')}))"
_PARTS = f"coalesce({_ARRAY}, array({', '.join(_at('x', p) for p in QUESTION_PARTS)}))"
_TYPES = f"transform(coalesce(try_cast({_at('x', '@type')} as array<variant>), array({_at('x', '@type')})), t -> regexp_replace({_text('t')}, '{SCHEMA_PREFIX.replace(chr(92), chr(92) * 2)}', ''))"
_SAID = lambda key: f"(({_at('x', key)}) is not null and not is_variant_null({_at('x', key)}) and to_json({_at('x', key)}) not in ('\"\"', 'false', '0'))"


def _levels(rows: DataFrame, name: str, step: str, depth: int) -> DataFrame:
    """Adds ``name``: the blocks' values and what ``step`` reaches from them, to a depth."""
    for k in range(1, depth):
        before = f"{name}{k - 1}" if k > 1 else "_blocks"
        rows = rows.withColumn(f"{name}{k}", F.expr(f"filter(flatten(transform({before}, x -> {step})), x -> x is not null)"))
    every = ["_blocks", *(f"{name}{k}" for k in range(1, depth))]
    return rows.withColumn(name, F.expr(f"flatten(array({', '.join(every)}))")).drop(*every[1:])


def _distinct(nodes: str, value: str) -> Column:
    """Distinct texts that ``value`` finds in each node x (one, or an array of them)."""
    return F.expr(f"slice(array_distinct(filter(flatten(transform({nodes}, x -> {value})), t -> t is not null and t <> '')), 1, {KEPT})")


def _one(sql: str) -> str:
    return f"array({sql})"


def structured_facts(records: DataFrame) -> DataFrame:
    """Page records with ``ld_facts``, from their JSON-LD texts ``ld`` (an array): types, questions, countries, currencies, telephones, local_types, names, streets,
    localities, regions, postal_codes (arrays), invalid (blocks that do not parse), has_address, has_hours, has_geo, has_same_as."""
    parsed = F.transform(F.coalesce("ld", F.array().cast("array<string>")), lambda t: F.try_parse_json(t))
    rows = records.withColumn("_parsed", parsed).withColumn("_blocks", F.filter("_parsed", lambda v: v.isNotNull()))
    rows = _levels(rows, "_nodes", _CHILDREN, DEPTH)
    rows = _levels(rows, "_entities", _GRAPH, ENTITY_DEPTH)
    rows = _levels(rows, "_asked", _PARTS, DEPTH)
    rows = rows.withColumn("_nodes", F.expr(f"filter(_nodes, x -> {_OBJECT} is not null)"))
    rows = rows.withColumns({
        "_local": F.expr(f"filter(_nodes, x -> exists({_TYPES}, t -> t rlike '(?i){LOCAL_TYPE}'))"),
        "_places": F.expr(f"filter(_nodes, x -> array_contains({_TYPES}, 'PostalAddress'))"),
        "_questions": F.expr(f"filter(_asked, x -> array_contains({_TYPES}, 'Question'))"),
    })
    question = f"regexp_replace({_text(_at('x', 'name'))}, '\\\\s+', ' ')"
    string = lambda key: _one(_text(_at("x", key)))
    countries = _distinct("_nodes", _one(f"coalesce({_text(_at('x', 'addressCountry'))}, {_text(_at('x', 'addressCountry', 'name'))})"))
    lists = {
        "types": _distinct("_entities", _TYPES), "questions": F.filter(_distinct("_questions", _one(question)), lambda q: F.length(q).between(8, 200)), "countries": countries, "currencies": _distinct("_nodes", _one(f"upper({_text(_at('x', 'priceCurrency'))})")),
        "telephones": _distinct("_nodes", string("telephone")), "local_types": F.filter(_distinct("_local", _TYPES), lambda t: t.rlike(f"(?i){LOCAL_TYPE}")), "names": _distinct("_local", string("name")), "streets": _distinct("_places", string("streetAddress")),
        "localities": _distinct("_places", string("addressLocality")), "regions": _distinct("_places", string("addressRegion")), "postal_codes": _distinct("_places", string("postalCode")),
    }
    any_local = lambda *keys: F.expr(f"exists(_local, x -> {' or '.join(_SAID(k) for k in keys)})")
    rows = rows.withColumns({f"_{k}": v for k, v in lists.items()})
    facts = F.struct(
        *[F.col(f"_{k}").alias(k) for k in lists], F.size(F.filter("_parsed", lambda v: v.isNull())).alias("invalid"), ((F.size("_places") > 0) | (F.size("_countries") > 0)).alias("has_address"),
        any_local("openingHours", "openingHoursSpecification").alias("has_hours"), any_local("geo").alias("has_geo"), any_local("sameAs").alias("has_same_as"),
    )
    return rows.withColumn("ld_facts", facts).select(*records.columns, "ld_facts")


def faq_questions(facts: DataFrame) -> DataFrame:
    """Questions that pages mark up: ``site_id, page_id, place, question``."""
    return facts.select("site_id", "page_id", F.posexplode("ld_facts.questions").alias("place", "question"))
