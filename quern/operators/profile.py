"""Dataset profiles (VoID) and schemas, from quads: one pass and one aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.syntax import OWL, RDFS, SKOS, TYPE, XSD


def void_totals(quads: DataFrame) -> DataFrame:
    """``(triples, entities, classes, properties)``."""
    return quads.agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("entities"), F.count_distinct(F.when((F.col("p") == TYPE) & (F.col("o_kind") == "iri"), F.col("o"))).alias("classes"), F.count_distinct("p").alias("properties"))


def void_classes(quads: DataFrame) -> DataFrame:
    return quads.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri")).groupBy(F.col("o").alias("class")).agg(F.count_distinct("s").alias("entities"))


def void_properties(quads: DataFrame) -> DataFrame:
    return quads.groupBy(F.col("p").alias("property")).agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("distinct_subjects"), F.count_distinct("o", "o_kind").alias("distinct_objects"))


def linksets(quads: DataFrame, dataset_of) -> DataFrame:
    """Links that leave a dataset: counts by (source dataset, target dataset, property)."""
    rows = quads.where("o_kind = 'iri'").select(dataset_of(F.col("s")).alias("source"), dataset_of(F.col("o")).alias("target"), F.col("p").alias("property"))
    return rows.where("source <> target").groupBy("source", "target", "property").agg(F.count(F.lit(1)).alias("links"))


def common_prefix(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """The longest common prefix of a set of strings: that of its smallest and its largest, so two aggregates; null for a bare scheme."""
    ends = df.groupBy(*(keys or [])).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    shorter = F.least(F.char_length("lo"), F.char_length("hi"))
    differ = F.filter(F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>")), lambda i: F.substring("lo", i, F.lit(1)) != F.substring("hi", i, F.lit(1)))
    n = F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, shorter)
    prefix = F.substring(F.col("lo"), F.lit(1), n)
    return ends.select(*(keys or []), F.when(~prefix.rlike(r"^[a-z]+:/*$|^$"), prefix).alias("prefix"))


def extract_schema(quads: DataFrame) -> DataFrame:
    """``(class, property, range, uses)``: what the instances of each class carry; the range is the commonest datatype or target class, ties by name."""
    types = quads.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri")).select("s", F.col("o").alias("class")).distinct()
    target = types.select(F.col("s").alias("o"), F.col("class").alias("target"))
    said = quads.where(F.col("p") != TYPE)
    literals = said.where("o_kind = 'lit'").withColumn("target", F.lit(None).cast("string"))  # they name no entity, so they join none
    facts = literals.unionByName(said.where("o_kind <> 'lit'").join(target, "o", "left"))
    kind = F.when(F.col("o_kind") == "lit", F.coalesce("o_dt", F.lit(XSD + "string"))).otherwise(F.coalesce("target", F.lit(RDFS + "Resource")))
    uses = facts.join(types, "s").groupBy("class", F.col("p").alias("property"), kind.alias("range")).agg(F.count(F.lit(1)).alias("n"))
    best = uses.groupBy("class", "property").agg(F.min(F.struct((-F.col("n")).alias("n"), "range")).alias("b"), F.sum("n").alias("uses"))
    return best.select("class", "property", F.col("b.range").alias("range"), "uses")


def ontology_schema(quads: DataFrame, rounds: int = 20) -> DataFrame:
    """``(class, property, range, comment, parent)`` of the declared classes; a class has the properties of all its superclasses."""
    from quern.operators.closure import transitive_closure

    classes = quads.where((F.col("p") == TYPE) & F.col("o").isin(OWL + "Class", RDFS + "Class")).select(F.col("s").alias("class")).distinct()
    parent = quads.where((F.col("p") == RDFS + "subClassOf") & (F.col("o_kind") == "iri")).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    above = transitive_closure(parent, rounds=rounds).select(F.col("src").alias("class"), F.col("dst").alias("owner")).unionByName(classes.select("class", F.col("class").alias("owner"))).distinct()
    one = lambda p, name: quads.where(F.col("p") == p).groupBy(F.col("s").alias("property")).agg(F.min("o").alias(name))
    domains = quads.where(F.col("p") == RDFS + "domain").select(F.col("s").alias("property"), F.col("o").alias("owner"))
    props = domains.join(one(RDFS + "range", "range"), "property", "left").join(one(RDFS + "comment", "comment"), "property", "left")
    direct = parent.groupBy(F.col("src").alias("class")).agg(F.min("dst").alias("parent"))
    return above.join(classes, "class", "left_semi").join(props, "owner").select("class", "property", "range", "comment").distinct().join(direct, "class", "left")


def merge_schemas(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Declared properties win; those only found in the data fill the gaps."""
    d = declared.select("class", "property", "range", F.lit("declared").alias("origin"))
    f = found.select("class", "property", "range", F.lit("data").alias("origin"))
    return d.unionByName(f.join(d, ["class", "property"], "left_anti"))


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(class, change, old_n, new_n)`` for classes that were added, removed, or have another number of properties."""
    n = lambda df, name: df.groupBy("class").agg(F.count_distinct("property").alias(name))
    both = n(old, "old_n").join(n(new, "new_n"), "class", "full")
    change = F.when(F.col("old_n").isNull(), "added").when(F.col("new_n").isNull(), "removed").when(F.col("old_n") != F.col("new_n"), "changed")
    return both.withColumn("change", change).where("change is not null").select("class", "change", F.coalesce("old_n", F.lit(0)).alias("old_n"), F.coalesce("new_n", F.lit(0)).alias("new_n"))


def class_shapes(schema: DataFrame, name) -> DataFrame:
    """``(class, shape)``: a text with a line for each property of a class; ``name`` shortens IRIs."""
    line = F.concat(F.lit("  "), name(F.col("property")), F.lit(" "), name(F.coalesce("range", F.lit("."))), F.lit(" *"))
    body = schema.groupBy("class").agg(F.array_join(F.array_sort(F.collect_set(line)), " ;\n").alias("body"))
    return body.select("class", F.concat(name(F.col("class")), F.lit(" {\n"), "body", F.lit("\n}")).alias("shape"))


def enough(df: DataFrame, least: int) -> bool:
    """Whether a table has at least ``least`` rows; stops counting there."""
    return df.limit(least).count() >= least


def void_turtle(dataset: str, totals: dict, classes: list[tuple[str, int]], properties: list[tuple[str, int, int, int]], uri_space: str | None = None) -> str:
    """The profile as Turtle; the rows are those of the profile tables, a handful a dataset."""
    lines = ["@prefix void: <http://rdfs.org/ns/void#> .", f"@prefix xsd: <{XSD}> .", "", f"<{dataset}> a void:Dataset ;"]
    lines += [f"  void:{k} {totals[k]} ;" for k in ("triples", "entities", "classes", "properties")]
    if uri_space:
        lines.append(f'  void:uriSpace "{uri_space}" ;')
    lines += [f"  void:classPartition [ void:class <{c}> ; void:entities {n} ] ;" for c, n in classes]
    lines += [f"  void:propertyPartition [ void:property <{p}> ; void:triples {t} ; void:distinctSubjects {s} ; void:distinctObjects {o} ] ;" for p, t, s, o in properties]
    lines[-1] = lines[-1][:-1] + "."
    return "\n".join(lines) + "\n"


def labels(quads: DataFrame, preference: tuple[str, ...] = ("en", "", "la")) -> DataFrame:
    """``(s, label)``: one label for each subject by predicate and language preference."""
    wanted = [SKOS + "prefLabel", RDFS + "label"]
    rank = F.coalesce(*[F.when(F.coalesce("o_lang", F.lit("")) == p, F.lit(i)) for i, p in enumerate(preference)], F.lit(len(preference)))
    rows = quads.where(F.col("p").isin(*wanted) & (F.col("o_kind") == "lit")).withColumn("__r", rank).withColumn("__p", F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col("p")))
    best = rows.withColumn("__n", F.row_number().over(Window.partitionBy("s").orderBy("__r", "__p", "o"))).where("__n = 1")
    return best.select("s", F.col("o").alias("label"))
