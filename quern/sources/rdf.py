"""RDF files as quads: N-Triples and N-Quads by line, Turtle and RDF/XML by file."""

from __future__ import annotations

import hashlib
import json
import re
import warnings
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.syntax import RDF, TYPE, XSD, Iri, Lit, Parser, SparqlError, Var
from quern.operators.inference import materialize
from quern.runtime import durable, path_exists, ship
from quern.sources.graphs import QUADS

_XML = "{http://www.w3.org/XML/1998/namespace}"
_QUAD_COLUMNS = [f.name for f in QUADS.fields]


def sniff(path: str, head: bytes) -> str:
    """``rdfxml``, ``ntriples``, ``nquads``, ``jsonld`` or ``turtle``, by suffix, else by the first bytes."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    by = {"rdf": "rdfxml", "xml": "rdfxml", "owl": "rdfxml", "nt": "ntriples", "ntriples": "ntriples", "nq": "nquads", "nquads": "nquads", "json": "jsonld", "jsonld": "jsonld"}
    if suffix in by:
        return by[suffix]
    return "rdfxml" if head[:200].lstrip().startswith((b"<?xml", b"<rdf:")) else "turtle"


_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+?)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9\-]+))?)\s*(?:<([^>]*)>\s*)?\.\s*(?:#.*)?$'


def _unescape(c: Column) -> Column:
    """The common string escapes of N-Triples; a backslash is held back until last."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"')):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(out, F.lit("\u0000"), F.lit("\\"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples or N-Quads: split at lines, parsed by one expression in the JVM; any size.  Lines that are neither a statement, a comment nor
    blank are dropped (see :func:`bad_lines`)."""
    g = lambda i: F.nullif(F.regexp_extract("value", _LINE, i), F.lit(""))
    rows = spark.read.text(path).where(F.col("value").rlike(_LINE))
    subject = g(1)
    literal = F.when(F.col("value").rlike(r'^\s*\S+\s+<[^>]*>\s+"'), _unescape(F.regexp_extract("value", _LINE, 5)))
    kind = F.when(g(3).isNotNull(), "iri").when(literal.isNotNull(), "lit").otherwise("bnode")
    dt = F.when(literal.isNotNull(), F.coalesce(g(6), F.when(g(7).isNotNull(), F.lit(RDF + "langString")).otherwise(F.lit(XSD + "string"))))
    bare = F.when(subject.startswith("<"), F.substring(subject, F.lit(2), F.length(subject) - 2)).otherwise(subject)
    return rows.select(g(8).alias("g"), bare.alias("s"), F.when(subject.startswith("<"), "iri").otherwise("bnode").alias("s_kind"), g(2).alias("p"), F.coalesce(g(3), literal, g(4)).alias("o"), kind.alias("o_kind"), dt.alias("o_dt"), F.lower(g(7)).alias("o_lang"))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


class _Turtle(Parser):
    """Turtle by the query parser's tokens: the two languages share terms, property lists and abbreviations."""

    def __init__(self, text: str, scope: str):
        text = re.sub(r"(?im)^\s*@prefix\s+([\w.\-]*:)\s*(<[^>]*>)\s*\.", r"PREFIX \1 \2", text)
        text = re.sub(r"(?im)^\s*@base\s+(<[^>]*>)\s*\.", r"BASE \1", text)
        super().__init__(text)
        self.scope = scope
        self.out: list[tuple] = []

    def statements(self) -> list[tuple]:
        while self.peek()[0] != "end":
            if self.take_word("PREFIX"):
                name, iri = self.next()[1], self.next()[1]
                self.prefixes[name[:-1]] = iri[1:-1] if re.match(r"[A-Za-z][\w+.\-]*:", iri[1:-1]) else self.base + iri[1:-1]
            elif self.take_word("BASE"):
                self.base = self.next()[1][1:-1]
            else:
                s = self.rdf_node()
                if not self.is_op("."):
                    self.pairs(s)
                self.expect(".")
        return self.out

    def rdf_node(self):
        if self.take("["):
            b = self.blank()
            if not self.take("]"):
                self.pairs(b)
                self.expect("]")
            return b
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.rdf_node())
            head = Iri(RDF + "nil")
            for item in reversed(items):
                cell = self.blank()
                self.emit(cell, RDF + "first", item)
                self.emit(cell, RDF + "rest", head)
                head = cell
            return head
        return self.term()

    def blank(self) -> Var:
        self.hidden += 1
        return Var(f"a{self.hidden}")

    def pairs(self, s) -> None:
        while True:
            p = self.path_iri()
            while True:
                self.emit(s, p.value, self.rdf_node())
                if not self.take(","):
                    break
            more = False
            while self.take(";"):
                more = True
            if not more or self.is_op(".") or self.is_op("]"):
                return

    def label(self, v: Var) -> str:
        return "_:" + hashlib.md5(f"{self.scope}|{v.name}".encode()).hexdigest()[:16]

    def emit(self, s, p: str, o) -> None:
        sub = (s.value, "iri") if isinstance(s, Iri) else (self.label(s), "bnode")
        if isinstance(o, Iri):
            obj = (o.value, "iri", None, None)
        elif isinstance(o, Lit):
            obj = (o.value, "lit", o.datatype, o.lang)
        else:
            obj = (self.label(o), "bnode", None, None)
        self.out.append((None, *sub, p, *obj))


def parse_turtle(text: str, scope: str = "") -> list[tuple]:
    """Quads of a Turtle text; blank nodes are named by ``scope``, so the same file always gives the same names."""
    return _Turtle(text, scope).statements()


def parse_rdfxml(text: str, scope: str = "") -> list[tuple]:
    """Quads of an RDF/XML text: node elements, typed nodes, property attributes, nested nodes, resources, datatypes, languages."""
    root = ET.fromstring(text)
    out: list[tuple] = []
    count = [0]
    name = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def blank(key: str | None = None) -> str:
        count[0] += 1
        return "_:" + hashlib.md5(f"{scope}|{key or count[0]}".encode()).hexdigest()[:16]

    def node(el: ET.Element, base: str, lang: str | None) -> tuple[str, str]:
        base, lang = el.get(_XML + "base", base), el.get(_XML + "lang", lang)
        about, ident, nid = el.get(f"{{{RDF}}}about"), el.get(f"{{{RDF}}}ID"), el.get(f"{{{RDF}}}nodeID")
        if about is not None:
            s = (about if re.match(r"[A-Za-z][\w+.\-]*:", about) else base + about, "iri")
        elif ident is not None:
            s = (f"{base}#{ident}", "iri")
        else:
            s = (blank(nid and "n" + nid), "bnode")
        if name(el.tag) != RDF + "Description":
            out.append((None, *s, TYPE, name(el.tag), "iri", None, None))
        for k, v in el.attrib.items():
            if not k.startswith((_XML, f"{{{RDF}}}")) and k.startswith("{"):
                out.append((None, *s, name(k), v, "lit", XSD + "string" if not lang else RDF + "langString", lang))
        for child in el:
            prop(child, s, base, lang)
        return s

    def prop(el: ET.Element, s: tuple[str, str], base: str, lang: str | None) -> None:
        lang = el.get(_XML + "lang", lang)
        p, res, nid, kind = name(el.tag), el.get(f"{{{RDF}}}resource"), el.get(f"{{{RDF}}}nodeID"), el.get(f"{{{RDF}}}parseType")
        if res is not None:
            out.append((None, *s, p, res if re.match(r"[A-Za-z][\w+.\-]*:", res) else base + res, "iri", None, None))
        elif nid is not None:
            out.append((None, *s, p, blank("n" + nid), "bnode", None, None))
        elif kind == "Resource":
            b = (blank(), "bnode")
            out.append((None, *s, p, *b, None, None))
            for child in el:
                prop(child, b, base, lang)
        elif len(el):
            for child in el:
                out.append((None, *s, p, *node(child, base, lang), None, None))
        else:
            dt = el.get(f"{{{RDF}}}datatype")
            tag = None if dt else (lang.lower() if lang else None)
            out.append((None, *s, p, el.text or "", "lit", dt or (RDF + "langString" if tag else XSD + "string"), tag))

    top = root if name(root.tag) == RDF + "RDF" else [root]
    for el in top:
        node(el, root.get(_XML + "base", ""), root.get(_XML + "lang"))
    return out


def parse_jsonld(text: str, scope: str = "") -> list[tuple]:
    """Quads of a JSON-LD text whose context is inside it: prefixes, ``@vocab``, ``@base``, term definitions with types and languages, nested nodes,
    ``@graph`` (named where it has an ``@id``), ``@list`` and ``@set``, value objects.  Remote contexts are not fetched."""
    out: list[tuple] = []
    count = [0]

    def blank(name: str | None = None) -> str:
        count[0] += 1
        return "_:" + hashlib.md5(f"{scope}|{name or count[0]}".encode()).hexdigest()[:16]

    def iri(name: str, ctx: dict, vocab: bool) -> str:
        if name.startswith("_:"):
            return blank(name)
        if vocab and name in ctx:
            term = ctx[name]
            target = term.get("@id", name) if isinstance(term, dict) else term
            if target != name:
                return iri(target, ctx, True)
        prefix, _, local = name.partition(":")
        if local and not local.startswith("//") and isinstance(ctx.get(prefix), str):
            return ctx[prefix] + local
        if re.match(r"[A-Za-z][\w+.\-]*:", name):
            return name
        return (ctx.get("@vocab", "") if vocab else ctx.get("@base", "")) + name

    def literal(v: object, dt: str | None, lang: str | None) -> tuple:
        if lang and isinstance(v, str) and not dt:
            return v, "lit", RDF + "langString", lang.lower()
        own = XSD + ("boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "double" if isinstance(v, float) else "string")
        return (str(v).lower() if isinstance(v, bool) else str(v)), "lit", dt or own, None

    def value(v: object, term: dict, ctx: dict, graph: str | None) -> tuple:
        if isinstance(v, dict):
            if "@value" in v:
                return literal(v["@value"], iri(v["@type"], ctx, True) if "@type" in v else None, v.get("@language"))
            if "@list" in v:
                head = (RDF + "nil", "iri", None, None)
                for x in reversed(v["@list"]):
                    cell = blank()
                    out.append((graph, cell, "bnode", RDF + "first", *value(x, term, ctx, graph)))
                    out.append((graph, cell, "bnode", RDF + "rest", *head))
                    head = (cell, "bnode", None, None)
                return head
            return (*node(v, ctx, graph), None, None)
        kind = term.get("@type")
        if kind in ("@id", "@vocab") and isinstance(v, str):
            x = iri(v, ctx, kind == "@vocab")
            return x, "bnode" if x.startswith("_:") else "iri", None, None
        return literal(v, iri(kind, ctx, True) if kind else None, term.get("@language", ctx.get("@language")))

    def node(n: dict, ctx: dict, graph: str | None) -> tuple[str, str]:
        own = n.get("@context") or {}
        for part in own if isinstance(own, list) else [own]:
            if isinstance(part, str):
                raise SparqlError(f"the remote context {part} is not fetched")
            ctx = {**ctx, **part}
        s = iri(n["@id"], ctx, False) if "@id" in n else blank()
        kind = "bnode" if s.startswith("_:") else "iri"
        for key, vs in n.items():
            vs = vs if isinstance(vs, list) else [vs]
            if key == "@type":
                out.extend((graph, s, kind, TYPE, iri(t, ctx, True), "iri", None, None) for t in vs)
            elif key == "@graph":
                for x in vs:
                    node(x, ctx, s if "@id" in n else graph)
            elif not key.startswith("@"):
                term = ctx.get(key) if isinstance(ctx.get(key), dict) else {}
                p = iri(key, ctx, True)
                if not re.match(r"[A-Za-z][\w+.\-]*:", p):
                    continue  # no IRI: the key says nothing
                for v in vs:
                    for x in v["@set"] if isinstance(v, dict) and "@set" in v else [v]:
                        if x is not None:
                            out.append((graph, s, kind, p, *value(x, term, ctx, graph)))
        return s, kind

    doc = json.loads(text)
    for n in doc if isinstance(doc, list) else [doc]:
        node(n, {}, None)
    return out


def parse_text(path: str, data: bytes) -> list[tuple]:
    kind = sniff(path, data)
    text = data.decode("utf-8")
    if kind == "rdfxml":
        return parse_rdfxml(text, path)
    if kind == "jsonld":
        return parse_jsonld(text, path)
    if kind in ("ntriples", "nquads"):
        raise SparqlError("line formats are read by read_lines")
    return parse_turtle(text, path)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Quads of one file whose name starts with ``_``, which Spark's readers pass over: a dataset's ontology, read on the driver."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.createDataFrame(parse_text(path.rsplit("/", 1)[-1], text.encode()), QUADS)


def read_files(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Turtle, RDF/XML and JSON-LD files (also mixed, the format is sniffed): one file is one unit of work, files are spread over the tasks.

    Files whose name starts with ``_`` are sidecars and are passed over.  A file that cannot be parsed fails the read; with ``strict`` off it is dropped.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).where(~F.substring_index("path", "/", -1).startswith("_")).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                try:
                    rows = parse_text(p.rsplit("/", 1)[-1], bytes(content))
                except Exception:
                    if strict:
                        raise
                    continue
                yield pd.DataFrame(rows, columns=_QUAD_COLUMNS)

    return files.mapInPandas(parse, QUADS)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """``(path, triples, error)`` for each file, parsed strictly."""

    ship(spark)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                try:
                    rows.append((p, len(set(parse_text(p.rsplit("/", 1)[-1], bytes(content)))), None))
                except Exception as e:
                    rows.append((p, 0, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "triples", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(check, "path string, triples long, error string")


def load(spark: SparkSession, path: str, kind: str = "files") -> DataFrame:
    """Quads of a path as a set: a statement given twice is one."""
    return (read_lines if kind == "lines" else read_files)(spark, path).distinct()


def file_kinds(spark: SparkSession, path: str) -> DataFrame:
    """``(file, kind)``: the format of each file, by its suffix, else by its first bytes."""
    ship(spark)

    @F.pandas_udf("string")
    def kind(names: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([sniff(n, bytes(h)) for n, h in zip(names, heads)])

    name = F.substring_index("path", "/", -1)
    return spark.read.format("binaryFile").load(path).select(name.alias("file"), kind(name, F.substring("content", 1, 200)).alias("kind"))


def load_dataset(spark: SparkSession, folder: str, ontologies: Sequence[str] = (), infer: bool = True) -> DataFrame:
    """A dataset's quads: its data files (those starting with ``_`` are sidecars), then its ``_ontology.ttl`` if it has one, then bundled
    ontologies, as a set; then what follows from them.  Data that cannot be read fail the load; inference that fails is a warning."""
    quads = read_files(spark, folder)
    own = f"{folder.rstrip('/')}/_ontology.ttl"
    for path in ([own] if path_exists(spark, own) else []) + list(ontologies):
        quads = quads.unionByName(read_sidecar(spark, path) if path.rsplit("/", 1)[-1].startswith("_") else read_files(spark, path))
    quads = durable(quads.distinct())
    if not infer:
        return quads
    try:
        return quads.unionByName(materialize(quads))
    except Exception as e:  # the facts that were loaded are worth having without what follows from them
        warnings.warn(f"inference over {folder} failed: {e}", stacklevel=2)
        return quads


def inject_entities(xml: Column, entities: dict[str, str]) -> Column:
    """An RDF/XML text with a DOCTYPE that declares the entities it uses, before its first element; texts that have one stay."""
    declared = "<!DOCTYPE rdf:RDF [" + "".join(f'<!ENTITY {k} "{v}">' for k, v in entities.items()) + "]>"
    head = F.regexp_extract(xml, r"^(\s*<\?xml[^>]*\?>)?", 0)
    return F.when(xml.contains("<!DOCTYPE"), xml).otherwise(F.concat(head, F.lit(declared), F.substring(xml, F.char_length(head) + 1, F.char_length(xml))))


def correct_text(text: Column, corrections: dict[str, str]) -> Column:
    """A text with known slips replaced, one after the other."""
    for bad, good in corrections.items():
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def rewrite_namespace(quads: DataFrame, old: str, new: str) -> DataFrame:
    """Every IRI of one namespace moved to another."""
    move = lambda c: F.when(F.col(c).startswith(old), F.concat(F.lit(new), F.substring(F.col(c), len(old) + 1, 2**31 - 1))).otherwise(F.col(c))
    out = quads.withColumn("s", F.when(F.col("s_kind") == "iri", move("s")).otherwise(F.col("s"))).withColumn("p", move("p"))
    return out.withColumn("o", F.when(F.col("o_kind") == "iri", move("o")).otherwise(F.col("o")))


def repair_iris(lines: DataFrame, column: str = "value") -> DataFrame:
    """Known slips in text dumps: encoded fragment marks, and type IRIs without their middle part (never inserted twice)."""
    c = F.replace(F.col(column), F.lit("%23"), F.lit("#"))
    return lines.withColumn(column, F.regexp_replace(c, r"(/vocabularies/)(?!place-types/)", "$1place-types/"))


def write_lines(quads: DataFrame, path: str) -> None:
    """Quads as N-Quads text."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    node = lambda c, k: F.when(F.col(k) == "iri", F.concat(F.lit("<"), F.col(c), F.lit(">"))).otherwise(F.col(c))
    suffix = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang"))).when(F.col("o_dt").isNotNull() & (F.col("o_dt") != XSD + "string"), F.concat(F.lit("^^<"), F.col("o_dt"), F.lit(">"))).otherwise(F.lit(""))
    obj = F.when(F.col("o_kind") == "lit", F.concat(F.lit('"'), esc(F.col("o")), F.lit('"'), suffix)).otherwise(node("o", "o_kind"))
    graph = F.when(F.col("g").isNotNull(), F.concat(F.lit(" <"), F.col("g"), F.lit(">"))).otherwise(F.lit(""))
    quads.select(F.concat(node("s", "s_kind"), F.lit(" <"), F.col("p"), F.lit("> "), obj, graph, F.lit(" ."))).write.text(path)
