"""Link files (YAML) as link rows and as quads with provenance; manifests and layers; context files."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.syntax import OWL, RDF, SKOS, XSD
from quern.sources.graphs import QUADS

# Names of relationships in link files and their IRIs.
RELATIONSHIPS = {
    "owl:sameAs": OWL + "sameAs", "skos:closeMatch": SKOS + "closeMatch", "skos:exactMatch": SKOS + "exactMatch",
    "dcterms:spatial": "http://purl.org/dc/terms/spatial", "dcterms:temporal": "http://purl.org/dc/terms/temporal",
}
PROV, DCT = "http://www.w3.org/ns/prov#", "http://purl.org/dc/terms/"
LINK_NS = "urn:link:"
LINKS = "link_id string, source string, target string, relationship string, confidence string, basis string, method string, author string, date string, source_dataset string, target_dataset string, note string"


def read_link_file(path: str | Path) -> list[tuple]:
    """The links of one file; a link's own confidence wins over the file's; the default is ``candidate``.  Unknown relationships raise."""
    import yaml

    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f) or {}
    m = doc.get("metadata", {})
    name = m.get("relationship")
    if name not in RELATIONSHIPS and name not in RELATIONSHIPS.values():
        raise ValueError(f"unknown relationship {name!r} in {path}")
    iri = RELATIONSHIPS.get(name, name)
    return [(x["source"], x["target"], iri, x.get("confidence") or m.get("confidence") or "candidate", m.get("basis"), m.get("method"), m.get("author"), str(m["date"]) if m.get("date") else None, m.get("source_dataset"), m.get("target_dataset"), x.get("note")) for x in doc.get("links", [])]


def load_links(spark: SparkSession, paths: list[str | Path]) -> DataFrame:
    """Links of several files.  ``link_id`` is a digest of the link's contents, so that loading again gives the same ids."""
    rows = [r for p in paths for r in read_link_file(p)]
    df = spark.createDataFrame(rows, LINKS.replace("link_id string, ", ""))
    key = F.concat_ws("\u0001", "source", "target", "relationship", "confidence", "basis", "method", "author", "date", "note")
    return df.select(F.sha2(key, 256).alias("link_id"), *df.columns).dropDuplicates(["link_id"])


def link_quads(links: DataFrame) -> DataFrame:
    """One named graph for each link, and in the provenance graph six statements about it (seven with a note)."""
    g = F.concat(F.lit(LINK_NS), "link_id")
    row = lambda graph, s, p, o, kind, dt: F.struct(graph.alias("g"), s.alias("s"), F.lit("iri").alias("s_kind"), (p if not isinstance(p, str) else F.lit(p)).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    prov = F.lit(LINK_NS + "provenance")
    said = lambda p, c: row(prov, g, p, F.coalesce(F.col(c), F.lit("")), "lit", XSD + "string")
    cells = F.array(
        row(g, F.col("source"), F.col("relationship"), F.col("target"), "iri", None),
        row(prov, g, RDF + "type", F.lit(PROV + "Entity"), "iri", None), said(LINK_NS + "confidence", "confidence"), said(LINK_NS + "method", "method"),
        said(LINK_NS + "basis", "basis"), said(PROV + "wasAttributedTo", "author"), row(prov, g, DCT + "created", F.coalesce(F.col("date"), F.lit("")), "lit", XSD + "date"),
        F.when(F.col("note").isNotNull(), said(LINK_NS + "note", "note")),
    )
    return links.sparkSession.createDataFrame([], QUADS).unionByName(links.select(F.explode(cells).alias("q")).where("q is not null").select("q.*"))


def load_context(folder: str | Path) -> dict[str, object]:
    """Prefixes, schemas, examples and tips of a dataset folder; a missing file is empty."""
    import yaml

    out: dict[str, object] = {}
    for part in ("prefixes", "schemas", "examples", "tips"):
        p = Path(folder) / f"{part}.yaml"
        out[part] = (yaml.safe_load(p.read_text(encoding="utf-8")) or {}) if p.exists() else {}
    return out


def layer_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(filename, change)`` of two layer lists ``(filename, digest)``: added, removed or changed files."""
    o, n = old.select("filename", F.col("digest").alias("od")), new.select("filename", F.col("digest").alias("nd"))
    change = F.when(F.col("od").isNull(), "added").when(F.col("nd").isNull(), "removed").when(F.col("od") != F.col("nd"), "changed")
    return o.join(n, "filename", "full").withColumn("change", change).where("change is not null").select("filename", "change")


def change_kind(changes: DataFrame) -> str:
    """``data`` if any data file changed, ``sidecar`` if only files starting with ``_`` did, else ``none``."""
    kinds = changes.agg(F.max(F.when(F.col("filename").startswith("_"), 1).otherwise(2)).alias("k")).first()["k"]
    return {None: "none", 1: "sidecar", 2: "data"}[kinds]


def orphan_layers(layers: DataFrame, manifests: DataFrame, older_than: int) -> DataFrame:
    """Cached layers that no manifest names and that are older than so many days."""
    return layers.join(manifests.select("digest").distinct(), "digest", "left_anti").where(F.col("age_days") > older_than)


def bill_of_materials(manifests: DataFrame, annotations: DataFrame) -> DataFrame:
    joined = manifests.join(annotations, "dataset", "left")
    return joined.select("dataset", "digest", *[F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("license", "version", "citation")])


def upsert_registry(path: str | Path, dataset: str, entry: dict) -> dict:
    """A dataset's entry in a small JSON registry; written to a new file first, so a reader never sees half of it."""
    p = Path(path)
    registry = json.loads(p.read_text()) if p.exists() else {}
    registry[dataset] = registry.get(dataset, {}) | entry
    tmp = p.with_suffix(".tmp")
    tmp.write_text(json.dumps(registry, indent=1, sort_keys=True))
    os.replace(tmp, p)
    return registry


def context_tables(spark: SparkSession, folder: str | Path) -> dict[str, DataFrame]:
    """The context of a dataset as tables: ``prefixes(prefix, namespace)``, ``examples(question, sparql, classes)``, ``tips(title, body, classes)`` and
    ``schema(class, property, range, comment, open_world)``."""
    c = load_context(folder)
    as_list = lambda x: list(x or [])
    prefixes = (c["prefixes"] or {}).get("prefixes", c["prefixes"]) or {}
    examples = [(e["question"], e.get("sparql"), as_list(e.get("classes"))) for e in (c["examples"] or {}).get("examples", [])]
    tips = [(t["title"], t.get("body"), as_list(t.get("classes"))) for t in (c["tips"] or {}).get("tips", [])]
    schema = []
    for cls, body in ((c["schemas"] or {}).get("classes", {}) or {}).items():
        for p in body.get("properties", []):
            schema += [(cls, p["pred"], r, p.get("comment"), bool(p.get("open_world"))) for r in (p["range"] if isinstance(p.get("range"), list) else [p.get("range")])]
    return {
        "prefixes": spark.createDataFrame(list(prefixes.items()), "prefix string, namespace string"),
        "examples": spark.createDataFrame(examples, "question string, sparql string, classes array<string>"),
        "tips": spark.createDataFrame(tips, "title string, body string, classes array<string>"),
        "schema": spark.createDataFrame(schema, "class string, property string, range string, comment string, open_world boolean"),
    }


def shorten(iri: str, prefixes: dict[str, str]) -> str:
    """``prefix:local`` by the longest namespace that fits; other IRIs stay."""
    fits = [(len(ns), p, ns) for p, ns in prefixes.items() if iri.startswith(ns)]
    return f"{max(fits)[1]}:{iri[max(fits)[0]:]}" if fits else iri


def schema_yaml(schema: DataFrame, prefixes: dict[str, str]) -> str:
    """An extracted schema ``(class, property, range[, comment])`` as the YAML of a context folder; a row a property, so read on the driver."""
    import yaml

    classes: dict[str, dict] = {}
    for r in sorted(schema.collect(), key=lambda r: (r["class"], r["property"])):
        line = {"pred": shorten(r["property"], prefixes), "range": shorten(r["range"], prefixes) if r["range"] else None}
        if "comment" in r and r["comment"]:
            line["comment"] = r["comment"]
        classes.setdefault(shorten(r["class"], prefixes), {"properties": []})["properties"].append(line)
    return yaml.safe_dump({"prefixes": prefixes, "classes": classes}, allow_unicode=True, sort_keys=True)


def render(rows: DataFrame, form: str = "md", order: list[str] | None = None) -> str:
    """A small table (manifests, reports) as a Markdown table or as JSON."""
    names = rows.columns
    data = [r.asDict() for r in rows.orderBy(*(order or names)).collect()]
    if form == "json":
        return json.dumps(data, ensure_ascii=False, default=str, indent=1)
    if form != "md":
        raise ValueError(f"unknown form {form!r}")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *["| " + " | ".join(cell(d[n]) for n in names) + " |" for d in data]]) + "\n"
