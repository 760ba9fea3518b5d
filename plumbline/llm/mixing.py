"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions alone.

Tokens are summed per cell (source, language, topic); the cells' weights are raked in turn to each target marginal until all three
are met.  A document is kept with probability weight * budget / tokens of its cell, which is at most one: the raking
bounds each cell's weight by what it holds, and gives the rest to the other cells of the margin.  The draw is a hash of the seed, the id and the text, so
it is the same in every run, task and retry.

A topic is read off the whole text by the terms of fixed lists, whatever the text's form or length.

Default targets are each margin's token shares raised to an exponent below one, which lifts small sources.

Cells are a summary: their number depends on the labels and not on the rows.  A small number of cells (counted) is raked in one
partition and broadcast to the documents; a larger one is raked by shuffles and joined by a merge join.

Cases: null labels are the label "" of their margin; a null or blank text has no tokens and is kept with its cell's probability, or
dropped where its cell has no tokens; repeated rows share their fate; targets name no label: its weight is 0; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

MARGINS = ("source", "lang", "topic")
EXPONENTS = {"source": 0.7, "lang": 0.7, "topic": 0.8}
#: Share of all tokens to keep, the seed of the draw, and when the raking ends.
BUDGET, SEED, TOLERANCE, ROUNDS = 0.6, 17, 1e-4, 24
#: Cells that are raked in one partition and broadcast (some 100 bytes each).
SMALL = 50_000
#: Terms of each topic in English, German, French and Spanish, in lower case; a term is in one topic.
TOPICS = {
    "law": "law laws legal court courts judge lawyer contract contracts statute license licenses licence licensed copyright liability warranty gesetz gericht vertrag richter recht loi tribunal contrat juge avocat ley juez contrato abogado",
    "medicine": "health medical medicine doctor doctors patient patients hospital disease diseases drug drugs clinical treatment therapy cancer vaccine gesundheit arzt krankheit krankenhaus santé médecin maladie hôpital salud médico enfermedad",
    "technology": "software computer computers internet server servers network code program programming algorithm database data hardware website browser rechner programm datenbank logiciel ordinateur réseau ordenador programa red",
    "science": "science scientific research physics chemistry biology experiment experiments theory molecule energy quantum galaxy planet species wissenschaft forschung physik chemie physique chimie ciencia investigación física química",
    "business": "business market markets price prices company companies bank banks money investment investor stock stocks finance financial economy trade tax profit wirtschaft markt preis geld firma unternehmen marché prix argent entreprise banque mercado precio dinero empresa banco",
    "politics": "government election elections president minister parliament congress senate political politics policy party vote voters war military regierung wahl präsident partei politik krieg gouvernement élection politique guerre gobierno elección política guerra",
    "sport": "sport sports football soccer basketball tennis team teams player players match league championship coach olympic goal goals fußball mannschaft spieler équipe joueur fútbol equipo jugador deporte",
    "arts": "art artist music song songs film films movie movies book books novel poem poetry theatre museum painting kunst musik buch theater musique livre roman peinture música libro película pintura",
    "education": "school schools student students teacher teachers university college lesson lessons exam exams curriculum education classroom schule schüler lehrer universität bildung école élève professeur université escuela estudiante profesor universidad",
    "food": "food recipe recipes cook cooking kitchen restaurant sugar butter cheese bread meat vegetable vegetables fruit wine essen rezept küche brot fleisch recette cuisine pain fromage viande receta cocina pan queso carne",
    "travel": "travel trip hotel hotels airport flight flights tourist tourism beach passport journey vacation holiday reise flughafen urlaub voyage vol plage aéroport vacances viaje vuelo playa aeropuerto turismo",
}


def n_tokens(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _tree(words: set[str]) -> str:
    """A pattern that matches the words and branches on each character once."""
    heads: dict[str, set[str]] = {}
    for w in words - {""}:
        heads.setdefault(w[0], set()).add(w[1:])
    one = "(?:" + "|".join(k + _tree(v) for k, v in sorted(heads.items())) + ")" if heads else ""
    return one + ("?" if heads and "" in words else "")


def topic_of(text: str = "text") -> Column:
    """The topic whose terms occur most often in the whole text, the first of those that tie; "other" where no term occurs."""
    pattern = r"(?<![\p{L}\p{N}])" + _tree({w for ws in TOPICS.values() for w in ws.split()}) + r"(?![\p{L}\p{N}])"
    hits = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0))

    def count(found: Column, words: str) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(*words.split())))

    def best(found: Column) -> Column:
        n = [F.struct(count(found, ws).alias("n"), F.lit(-i).alias("i"), F.lit(t).alias("topic")) for i, (t, ws) in enumerate(TOPICS.items())]
        return F.when(F.size(found) == 0, "other").otherwise(F.greatest(*n)["topic"])

    # the lambda's argument is found once
    return F.element_at(F.transform(F.array(hits), best), 1)


def draw_of() -> Column:
    """A number from 0 to 1 for each document."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text"), 11) / F.lit(float(1 << 53))


def rows_label(margin: str, topic: Column | None = None) -> Column:
    label = (topic_of() if topic is None else topic) if margin == "topic" else F.col(margin)
    return F.coalesce(label.cast("string"), F.lit(""))


def labelled(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, draw`` of each document."""
    return docs.select("doc_id", *[rows_label(c, topic).alias(c) for c in MARGINS], n_tokens().alias("n_tokens"), draw_of().alias("draw"))


def _targets(cells: DataFrame, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """Adds each margin's target share, ``t_<margin>``."""
    for c in MARGINS:
        if targets and c in targets:
            given = targets[c]
            pairs = [x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))]
            # labels that no cell has cannot be met; the rest share the whole
            share = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(c)), F.lit(0.0))
        else:
            share = F.pow(F.sum("tokens").over(Window.partitionBy(c)).cast("double"), F.lit(EXPONENTS[c]))
        cells = cells.withColumn(f"t_{c}", share)
        first = F.row_number().over(Window.partitionBy(c).orderBy(*MARGINS)) == 1
        cells = cells.withColumn("_first", F.when(first, F.col(f"t_{c}")).otherwise(0.0))
        cells = cells.withColumn(f"t_{c}", F.col(f"t_{c}") / F.sum("_first").over(Window.partitionBy())).drop("_first")
    return cells


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with their raked weight, a share of the kept tokens: ``source, lang, topic, tokens, weight``."""
    cells = cells.where("tokens > 0")
    total = cells.agg(F.sum("tokens").alias("n"), F.count("*").alias("k")).first()
    if not total.k:
        return cells.withColumn("weight", F.lit(0.0))
    if total.k <= SMALL:
        cells = cells.coalesce(1)
    most = F.col("tokens") / F.lit(budget * total.n)
    now = written(_targets(cells, targets).withColumn("weight", F.least(F.col("tokens") / F.lit(total.n), most)))
    last = float("inf")
    for _ in range(0, rounds, 6):
        if total.k <= SMALL:
            now = now.coalesce(1)
        step = now.drop("gap")
        for _ in range(6):
            for c in MARGINS:
                have = F.sum("weight").over(Window.partitionBy(c))
                step = step.withColumn("weight", F.least(F.when(have > 0, F.col("weight") * F.col(f"t_{c}") / have).otherwise(0.0), most))
        gaps = [F.abs(F.sum("weight").over(Window.partitionBy(c)) - F.least(F.col(f"t_{c}"), F.sum(most).over(Window.partitionBy(c)))) for c in MARGINS]
        now = written(step.withColumn("gap", F.greatest(*gaps)))
        gap = now.agg(F.max("gap")).first()[0]
        if gap <= tolerance or abs(gap - last) <= tolerance:  # met, or as near as the bounds allow
            break
        last = gap
    return now.select(*MARGINS, "tokens", "weight")


def probabilities(rows: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float) -> tuple[DataFrame, bool]:
    """``source, lang, topic, probability`` of each cell of labelled rows, and whether there are few cells."""
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    raked = rake(cells, targets, budget)
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.count("*").alias("k")).first()
    chance = F.least(F.lit(1.0), F.col("weight") * F.lit(budget * float(total.n)) / F.col("tokens"))
    return raked.select(*MARGINS, chance.alias("probability")), total.k <= SMALL


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, budget: float = BUDGET) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, probability, kept`` for each document; the texts are read once."""
    rows = written(labelled(docs, topic))
    known, few = probabilities(rows, targets, budget)
    joined = rows.join(F.broadcast(known) if few else known.hint("merge"), list(MARGINS), "left")
    probability = F.coalesce("probability", F.lit(0.0))
    return joined.select("doc_id", *MARGINS, "n_tokens", probability.alias("probability"), (F.col("draw") < probability).alias("kept"))


def drawn(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, budget: float = BUDGET) -> DataFrame:
    """The documents that ``mix`` keeps, with all their columns."""
    rows = labelled(docs, topic)
    known, few = probabilities(rows, targets, budget)
    label = {c: rows_label(c, topic) for c in MARGINS}
    marked = docs.withColumns({f"_mix_{c}": label[c] for c in MARGINS} | {"_mix_draw": draw_of()})
    renamed = known.select(*[F.col(c).alias(f"_mix_{c}") for c in MARGINS], F.col("probability").alias("_mix_p"))
    joined = marked.join(F.broadcast(renamed) if few else renamed.hint("merge"), [f"_mix_{c}" for c in MARGINS])
    return joined.where("_mix_draw < _mix_p").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
