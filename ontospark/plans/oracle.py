"""The same queries as SQL for another engine, written independently of the DataFrame plans."""

from __future__ import annotations

from ..functions import vocab as v

ORACLE_SQL: dict[str, str] = {}
EX = "http://example.org/tpch#"

# Lists of this file's own, so that a wrong entry in the operators' lists shows.
CLASS_TYPES = [f"{v.OWL}Class", f"{v.RDFS}Class"]
PROPERTY_TYPES = [f"{v.OWL}ObjectProperty", f"{v.OWL}DatatypeProperty", f"{v.OWL}AnnotationProperty", f"{v.RDF}Property"]
LABELS = [f"{v.RDFS}label", f"{v.SKOS}prefLabel"]
DEFINITIONS = [f"{v.RDFS}comment", f"{v.SKOS}definition", f"{v.DCTERMS}description"]
HEADER_NOTES = [f"{v.RDFS}label", f"{v.RDFS}comment", f"{v.OWL}versionInfo", f"{v.OWL}versionIRI"]
SPACES = [v.RDF, v.RDFS, v.OWL, v.XSD]
TOPS = [f"{v.OWL}Thing", f"{v.RDFS}Resource"]
STOPPED = [
    "all", "also", "and", "any", "are", "been", "being", "both", "but", "can", "could", "did", "does", "each", "every", "few", "for", "from", "had", "has", "have", "how", "just", "may",
    "might", "more", "most", "must", "need", "not", "only", "other", "same", "shall", "should", "some", "such", "than", "that", "the", "this", "too", "very", "was", "were", "what", "when", "where",
    "which", "who", "whom", "whose", "why", "will", "with", "would",
]
EXPRESSIVE = [v.OWL + x for x in (
    "Restriction", "AllDisjointClasses", "AllDifferent", "equivalentClass", "disjointWith", "unionOf", "intersectionOf", "complementOf", "oneOf", "hasValue", "someValuesFrom", "allValuesFrom",
    "minCardinality", "maxCardinality", "cardinality", "minQualifiedCardinality", "maxQualifiedCardinality", "qualifiedCardinality", "hasSelf", "propertyChainAxiom", "hasKey",
)]
BASIC = [v.OWL + x for x in ("Ontology", "Class", "ObjectProperty", "DatatypeProperty", "AnnotationProperty", "NamedIndividual")]
TRAITS = [v.OWL + f"{x}Property" for x in ("Functional", "InverseFunctional", "Transitive", "Symmetric", "Asymmetric", "Reflexive", "Irreflexive")]
BETTER_HIGH = [
    "basic.classes", "basic.object_properties", "basic.datatype_properties", "documentation.classes_documented", "documentation.classes_documented_pct", "documentation.classes_labelled",
    "documentation.classes_labelled_pct", "documentation.properties_labelled", "documentation.properties_labelled_pct", "properties.domain_coverage", "properties.range_coverage", "properties.with_domain",
    "properties.with_range",
]
BETTER_LOW = ["connectivity.isolated_classes", "hierarchy.orphan_classes", "hierarchy.orphan_rate"]
#: Names of datatypes and what they stand for.
DATATYPES = {
    "string": "string", "str": "string", "text": "string", "integer": "integer", "int": "integer", "decimal": "decimal", "float": "float", "double": "double", "number": "decimal", "boolean": "boolean", "bool": "boolean",
    "date": "date", "datetime": "dateTime", "time": "time", "gyear": "gYear", "duration": "duration", "uri": "anyURI", "anyuri": "anyURI", "url": "anyURI", "base64": "base64Binary", "language": "language", "token": "token",
}
#: Constant triples as ``subject kind predicate object kind``; ex: is the graph's own namespace.
CONSTANTS = """ex:Ontology iri dc:title Trade literal
ex:Ontology iri dcterms:license ex:licence iri
ex:licence iri rdfs:label Open literal
ex:Ontology iri rdf:type owl:Ontology iri
ex:Entity iri rdf:type owl:Class iri
ex:type_ECONOMY iri rdfs:subClassOf ex:type_LARGE iri
ex:type_LARGE iri rdfs:subClassOf ex:type_MEDIUM iri
ex:type_MEDIUM iri rdfs:subClassOf ex:type_ECONOMY iri
ex:type_PROMO iri rdfs:subClassOf ex:type_SMALL iri
ex:Segment_AUTOMOBILE iri owl:disjointWith ex:Segment_BUILDING iri
ex:Segment_MACHINERY iri owl:equivalentClass ex:Segment_HOUSEHOLD iri
ex:totalPrice iri rdf:type owl:DatatypeProperty iri
ex:totalPrice iri rdfs:domain ex:Entity iri
ex:totalPrice iri rdfs:range xsd:decimal iri
ex:status iri rdf:type owl:DatatypeProperty iri
ex:status iri rdfs:domain ex:Entity iri
ex:status iri rdfs:range ex:StatusEnum iri
ex:contains iri rdf:type owl:ObjectProperty iri
ex:contains iri rdfs:domain ex:Entity iri
ex:note iri rdf:type owl:AnnotationProperty iri
ex:weight iri rdfs:domain ex:Entity iri
ex:height iri rdfs:range xsd:decimal iri
ex:StatusEnum iri owl:oneOf l0 bnode
l0 bnode rdf:first F literal
l0 bnode rdf:rest l1 bnode
l1 bnode rdf:first O literal
l1 bnode rdf:rest l2 bnode
l2 bnode rdf:first P literal
l2 bnode rdf:rest rdf:nil iri"""


def _fixed() -> str:
    spaces = {"ex": EX, "rdf": v.RDF, "rdfs": v.RDFS, "owl": v.OWL, "xsd": v.XSD, "dc": "http://purl.org/dc/elements/1.1/", "dcterms": v.DCTERMS}
    full = lambda x: spaces[x.split(":")[0]] + x.split(":")[1] if ":" in x else x
    return ", ".join(f"('{full(s)}', '{sk}', '{full(p)}', '{full(o)}', '{ok}', '', '')" for s, sk, p, o, ok in (x.split() for x in CONSTANTS.split("\n")))


def _iri(name: str, key: str) -> str:
    return f"'{EX}{name}' || {key}"


def graph_sql(version: int) -> str:
    """The projected graph of a version."""
    cus = "customer" if version == 1 else "(SELECT * FROM customer WHERE c_custkey % 7 <> 0)"
    name = "c_name" if version == 1 else "CASE WHEN c_custkey % 11 = 0 THEN c_name || ' v2' ELSE c_name END"
    dec, nn = v.XSD + "decimal", v.XSD + "nonNegativeInteger"

    def b(s: str, p: str, o: str, src: str, kind: str = "iri", dt: str = "", lang: str = "''", s_kind: str = "iri", where: str = "true", distinct: str = "") -> str:
        return f"SELECT {distinct} {s}, '{s_kind}', '{p}', {o}, '{kind}', '{dt}', {lang} FROM {src} WHERE {where}"

    reg, nat, cu, seg, sup, order = _iri("Region_", "r_regionkey"), _iri("Nation_", "n_nationkey"), _iri("Customer_", "c_custkey"), _iri("Segment_", "c_mktsegment"), _iri("supplies_", "s_suppkey"), _iri("order_", "o_orderkey")
    topic, event, r4, cls = _iri("Topic_", "(doc_id // 4)"), _iri("event_", "event_id"), "s_suppkey % 4 = 1", f"'{v.OWL_CLASS}'"
    q4 = "s_suppkey % 4 = 3"
    cell = lambda a: f"'part_' || k || '_' || {a}"
    pending = "(SELECT k, a, lead(a) OVER (PARTITION BY k ORDER BY a) AS n FROM (SELECT DISTINCT l_orderkey AS k, l_partkey AS a FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')))"
    money = lambda x: f"CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR)"
    parts = [
        f"SELECT * FROM (VALUES {_fixed()}) AS t(s, s_kind, p, o, o_kind, o_dt, o_lang)",
        b(reg, v.TYPE, cls, "region"), b(reg, v.SUBCLASS, f"'{EX}Entity'", "region"), b(reg, v.LABEL, "r_name", "region", "literal", lang="'en'"),
        b(nat, v.TYPE, cls, "nation"), b(nat, v.SUBCLASS, _iri("Region_", "n_regionkey"), "nation"), b(nat, v.LABEL, "n_name", "nation", "literal", lang="'en'"), b(nat, v.PREF_LABEL, "lower(n_name)", "nation", "literal"),
        b(cu, v.TYPE, cls, cus), b(cu, v.SUBCLASS, _iri("Nation_", "c_nationkey"), cus), b(cu, v.SUBCLASS, seg, cus, where="c_custkey % 2 = 0"), b(cu, v.SUBCLASS, f"'{EX}Entity'", cus, where="c_custkey % 10 = 0"),
        b(cu, v.LABEL, name, cus, "literal", lang="'en'", where="c_acctbal >= 0"), b(cu, v.COMMENT, "'Customer of ' || c_mktsegment", cus, "literal", where="c_custkey % 3 = 0"),
        b(seg, v.TYPE, f"'{v.RDFS_CLASS}'", cus, distinct="DISTINCT"), b(_iri("type_", "p_type"), v.TYPE, cls, "part", distinct="DISTINCT"),
        b(sup, v.TYPE, f"'{v.OBJECT_PROPERTY}'", "supplier"), b(sup, v.SUBPROPERTY, _iri("supplies_", "(s_suppkey // 10)"), "supplier", where="s_suppkey >= 10"),
        b(sup, v.DOMAIN, _iri("Nation_", "s_nationkey"), "supplier", where="s_suppkey % 4 <> 0"), b(sup, v.RANGE, f"'{EX}type_PROMO'", "supplier", where="s_acctbal >= 0"),
        b(sup, v.TYPE, f"'{v.FUNCTIONAL}'", "supplier", where="s_suppkey % 5 = 0"), b(sup, v.TYPE, f"'{v.SYMMETRIC}'", "supplier", where="s_suppkey % 6 = 0"),
        b(sup, v.INVERSE_OF, _iri("supplies_", "(s_suppkey + 1)"), "supplier", where="s_suppkey % 7 = 0"),
        b("'r_' || s_suppkey", v.TYPE, f"'{v.RESTRICTION}'", "supplier", s_kind="bnode", where=r4), b("'r_' || s_suppkey", v.ON_PROPERTY, sup, "supplier", s_kind="bnode", where=r4),
        b("'r_' || s_suppkey", v.MIN_CARD, "CAST(s_suppkey % 5 AS VARCHAR)", "supplier", "literal", nn, s_kind="bnode", where=f"{r4} AND s_suppkey % 3 = 0"),
        b("'r_' || s_suppkey", v.MAX_CARD, "CAST(s_suppkey % 4 AS VARCHAR)", "supplier", "literal", nn, s_kind="bnode", where=f"{r4} AND s_suppkey % 3 = 1"),
        b("'r_' || s_suppkey", v.SOME_VALUES, f"'{EX}type_PROMO'", "supplier", s_kind="bnode", where=f"{r4} AND s_suppkey % 3 = 2"),
        b(_iri("Nation_", "s_nationkey"), v.SUBCLASS, "'r_' || s_suppkey", "supplier", "bnode", where=r4),
        b("'q_' || s_suppkey", v.TYPE, f"'{v.RESTRICTION}'", "supplier", s_kind="bnode", where=q4), b("'q_' || s_suppkey", v.ON_PROPERTY, sup, "supplier", s_kind="bnode", where=q4), b(_iri("Nation_", "s_nationkey"), v.SUBCLASS, "'q_' || s_suppkey", "supplier", "bnode", where=q4),
        *(b("'q_' || s_suppkey", v.OWL + n, "CAST(s_suppkey % 4 AS VARCHAR)", "supplier", "literal", nn, s_kind="bnode", where=f"{q4} AND s_suppkey % 3 = {k}") for k, n in enumerate(("minQualifiedCardinality", "maxQualifiedCardinality", "qualifiedCardinality"))),
        *(b("'q_' || s_suppkey", v.OWL + n, f"'{of}'", "supplier", s_kind="bnode", where=f"{q4} AND s_suppkey % 3 = {k}") for k, (n, of) in enumerate((("onClass", EX + "type_PROMO"), ("onClass", EX + "type_SMALL"), ("onDataRange", v.XSD + "string")))),
        b(f"'{EX}Ontology'", v.DCTERMS + "creator", reg, "region"), b(nat, v.RDFS + "isDefinedBy", f"'{EX}Ontology'", "nation"), b(cu, v.SKOS + "note", money("c_acctbal"), cus, "literal", where="c_acctbal < 0"), b(_iri("part_", "p_partkey"), v.TYPE, _iri("type_", "p_type"), "part"),
        b(order, v.TYPE, _iri("Customer_", "o_custkey"), "orders"), b(order, EX + "totalPrice", money("o_totalprice"), "orders", "literal", dec), b(order, EX + "status", "o_orderstatus", "orders", "literal"),
        b(_iri("order_", "l_orderkey"), EX + "contains", _iri("part_", "l_partkey"), "lineitem", distinct="DISTINCT"),
        b(topic, v.TYPE, f"'{v.NAMED_INDIVIDUAL}'", "documents", distinct="DISTINCT"), b(topic, v.LABEL, "split_part(text, chr(10), 1)", "documents", "literal", lang="lang", where="length(split_part(text, chr(10), 1)) > 0", distinct="DISTINCT"),
        b(topic, v.COMMENT, "substr(text, instr(text, chr(10)) + 1)", "documents", "literal", lang="'en'", where="instr(text, chr(10)) > 0 AND length(text) > instr(text, chr(10))", distinct="DISTINCT"),
        b(_iri("parts_of_", "k"), v.ONE_OF, cell("min(a)"), pending, "bnode") + " GROUP BY k", b(cell("a"), v.FIRST, _iri("part_", "a"), pending, s_kind="bnode"),
        f"SELECT {cell('a')}, 'bnode', '{v.REST}', CASE WHEN n IS NULL THEN '{v.NIL}' ELSE {cell('n')} END, CASE WHEN n IS NULL THEN 'iri' ELSE 'bnode' END, '', '' FROM {pending}",
        b(_iri("EventType_", "event_type"), v.TYPE, cls, "events", distinct="DISTINCT"), b(event, v.TYPE, _iri("EventType_", "event_type"), "events"), b(event, EX + "by", _iri("user_", "user_id"), "events"),
        b(event, EX + "value", money("value"), "events", "literal", dec),
    ]
    if version == 2:
        parts += [b(_iri("VIP_", "c_custkey"), v.TYPE, cls, cus, where="c_custkey % 13 = 0"), b(_iri("VIP_", "c_custkey"), v.SUBCLASS, cu, cus, where="c_custkey % 13 = 0")]
    return "\nUNION ALL ".join(parts)


def _in(*iris: str) -> str:
    return "(" + ", ".join(f"'{i}'" for i in iris) + ")"


def local(x: str) -> str:
    return f"CASE WHEN contains({x}, '#') THEN regexp_extract({x}, '[^#]*$') ELSE regexp_extract({x}, '[^/]*$') END"


def ns(x: str) -> str:
    return f"CASE WHEN contains({x}, '#') THEN regexp_replace({x}, '[^#]*$', '') WHEN contains({x}, '/') THEN regexp_replace({x}, '[^/]*$', '') ELSE '' END"


PREFIXED = [("rdf", v.RDF), ("xsd", v.XSD), ("owl", v.OWL), ("rdfs", v.RDFS), ("skos", v.SKOS), ("ex", EX)]


def qname(x: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({x}, '{n}') THEN '{p}:' || substr({x}, {len(n) + 1})" for p, n in PREFIXED) + f" ELSE '<' || {x} || '>' END"


BUILTIN = "(" + " OR ".join(f"starts_with(uri, '{n}')" for n in SPACES) + ")"
G = f"g AS MATERIALIZED ({graph_sql(1)}),\n"
BOTH = f"g AS MATERIALIZED ({graph_sql(1)}), h AS MATERIALIZED ({graph_sql(2)}),\n"
#: Classes and properties, blank nodes too or IRIs only, and edges.
BASE = f"""c AS (SELECT DISTINCT s AS uri FROM g WHERE p = '{v.TYPE}' AND o IN {_in(*CLASS_TYPES)}),
ci AS (SELECT DISTINCT s AS uri FROM g WHERE s_kind = 'iri' AND p = '{v.TYPE}' AND o IN {_in(*CLASS_TYPES)}),
q AS (SELECT DISTINCT s AS uri FROM g WHERE p = '{v.TYPE}' AND o IN {_in(*PROPERTY_TYPES)}),
e AS (SELECT s AS src, o AS dst FROM g WHERE p = '{v.SUBCLASS}' AND s_kind = 'iri' AND o_kind = 'iri'),
up AS (SELECT src, dst FROM e UNION SELECT up.src, e.dst FROM up JOIN e ON up.dst = e.src),
"""


def sql(name: str, body: str, versions: bool = False) -> None:
    """``body`` goes on the WITH list: further tables, then the SELECT."""
    body = body.strip()
    head = "WITH RECURSIVE " + (BOTH if versions else G) + BASE
    if body.upper().startswith("SELECT"):
        head = head.rstrip().rstrip(",") + "\n"
    ORACLE_SQL[name] = head + body


NODE3 = "SELECT s AS uri FROM g WHERE s_kind = 'iri' UNION SELECT p FROM g UNION SELECT o FROM g WHERE o_kind = 'iri'"
RANK = "CASE WHEN p <> '{t}' THEN 8 {w} ELSE 7 END".format(t=v.TYPE, w=" ".join(f"WHEN o = '{i}' THEN {k}" for k, i in enumerate([v.ONTOLOGY, v.OWL_CLASS, v.RDFS_CLASS, v.OBJECT_PROPERTY, v.DATATYPE_PROPERTY, v.ANNOTATION_PROPERTY, v.RDF_PROPERTY])))
RANK_NAME = "CASE {x} WHEN 0 THEN 'ontology' WHEN 1 THEN 'class' WHEN 2 THEN 'class' WHEN 3 THEN 'object_property' WHEN 4 THEN 'datatype_property' WHEN 5 THEN 'annotation_property' WHEN 6 THEN 'object_property' WHEN 7 THEN 'individual' ELSE 'other' END"
CATEGORY = """CASE WHEN p LIKE '%type' OR contains(p, 'rdf-syntax-ns#type') THEN 'type'
 WHEN contains(p, 'subClassOf') OR contains(p, 'subPropertyOf') OR contains(p, 'equivalentClass') OR contains(p, 'equivalentProperty') THEN 'hierarchy'
 WHEN contains(p, 'domain') OR contains(p, 'range') THEN 'domain_range' WHEN contains(lower(p), 'label') OR contains(p, 'prefLabel') THEN 'label'
 WHEN regexp_matches(lower(p), 'comment|description|definition|note') THEN 'documentation'
 WHEN contains(lower(p), 'owl') AND regexp_matches(p, 'disjoint|inverse|functional|cardinality|restriction|union|intersection') THEN 'owl_axiom' ELSE 'other' END"""

sql("scan_projection", "SELECT p, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects, CAST(sum(length(o)) AS BIGINT) AS object_chars FROM g GROUP BY p")
sql("scan_ntriples", "SELECT p, o_kind, o_dt, o_lang, count(*) AS n, CAST(sum(length(o)) AS BIGINT) AS object_chars FROM g GROUP BY ALL")
sql("pattern_match", f"SELECT s FROM g WHERE p = '{v.TYPE}' AND o = '{v.OBJECT_PROPERTY}'")
sql("sel_classes", "SELECT uri FROM c")
sql("sel_classes_iri", "SELECT uri FROM ci")
sql("sel_properties", "SELECT uri FROM q")
KNOWN = f"SELECT s FROM g WHERE p = '{v.TYPE}' AND o IN {_in(*CLASS_TYPES, *PROPERTY_TYPES, v.ONTOLOGY)}"
sql("sel_individuals", f"SELECT DISTINCT s AS uri FROM g WHERE p = '{v.TYPE}' AND s NOT IN ({KNOWN})")
sql("sel_named_individuals", f"SELECT DISTINCT s AS uri FROM g WHERE p = '{v.TYPE}' AND s_kind = 'iri' AND s NOT IN ({KNOWN})")
sql("sel_selector_individuals", "SELECT s AS uri FROM g EXCEPT (SELECT uri FROM c UNION SELECT uri FROM q)")
sql("sel_selector_data_props", f"SELECT DISTINCT s AS uri FROM g WHERE p = '{v.TYPE}' AND o = '{v.DATATYPE_PROPERTY}'")
sql("referenced_uris", NODE3)
sql("deprecated_entities", f"SELECT * FROM (VALUES ('{EX}Segment_BUILDING'), ('{EX}Customer_0')) AS t(uri)")
sql("used_namespaces", f"t AS ({NODE3} UNION SELECT o_dt FROM g WHERE o_dt <> '') SELECT DISTINCT split_part({qname('uri')}, ':', 1) AS prefix FROM t WHERE NOT starts_with({qname('uri')}, '<')")
sql("inline_bnodes", "SELECT o AS bnode FROM g WHERE o_kind = 'bnode' GROUP BY o HAVING count(*) = 1")
sql("sel_entity_type", f"r AS (SELECT s, min({RANK}) AS k FROM g GROUP BY s) SELECT {RANK_NAME.format(x='k')} AS entity_type, count(*) AS n, min(s) AS first_uri FROM r GROUP BY 1")
sql("sel_subject_kind", "k AS (SELECT DISTINCT s, CASE WHEN s IN (SELECT uri FROM c) THEN 'class' WHEN s IN (SELECT uri FROM q) THEN 'property' ELSE 'individual' END AS kind FROM g) SELECT kind, count(*) AS n, max(s) AS last_uri FROM k GROUP BY kind")
sql("section_subgraph", "SELECT s, p, o FROM g WHERE s IN (SELECT uri FROM q)")
sql("predicate_category", f"SELECT p, {CATEGORY} AS category, count(*) AS n FROM g GROUP BY p")
sql("term_names", f"SELECT uri, {local('uri')} AS local, {ns('uri')} AS ns, {qname('uri')} AS qname FROM q")

# statistics: category, metric, num, den


def long_sql(category: str, metrics: dict[str, str | tuple[str, str]]) -> str:
    rows = []
    for m, x in metrics.items():
        num, den = x if isinstance(x, tuple) else (x, "1")
        rows.append(f"SELECT '{category}' AS category, '{m}' AS metric, CAST(({num}) AS BIGINT) AS num, CAST(({den}) AS BIGINT) AS den")
    return " UNION ALL ".join(rows)


def n_typed(*types: str, of: str = "g") -> str:
    return f"SELECT count(DISTINCT s) FROM {of} WHERE p = '{v.TYPE}' AND o IN {_in(*types)}"


def has(kind: str, predicates: list[str], of: str = "g") -> str:
    return f"SELECT count(*) FROM {kind} WHERE uri IN (SELECT s FROM {of} WHERE p IN {_in(*predicates)})"


def stats_sql(of: str = "g", c: str = "c", q: str = "q") -> dict[str, dict]:
    return {
        "basic": {
            "triples": f"SELECT count(*) FROM {of}", "classes": f"SELECT count(*) FROM {c}", "object_properties": n_typed(v.OBJECT_PROPERTY, of=of), "datatype_properties": n_typed(v.DATATYPE_PROPERTY, of=of),
            "annotation_properties": n_typed(v.ANNOTATION_PROPERTY, of=of), "individuals": f"SELECT count(DISTINCT s) FROM {of} WHERE p = '{v.TYPE}' AND s NOT IN ({KNOWN.replace('FROM g', f'FROM {of}')})",
        },
        "properties": {
            "with_domain": has(q, [v.DOMAIN], of), "with_range": has(q, [v.RANGE], of), "domain_coverage": (has(q, [v.DOMAIN], of), f"SELECT count(*) FROM {q}"), "range_coverage": (has(q, [v.RANGE], of), f"SELECT count(*) FROM {q}"),
            "inverse_pairs": f"SELECT count(DISTINCT s) FROM {of} WHERE p = '{v.INVERSE_OF}'", "functional": n_typed(v.FUNCTIONAL, of=of), "symmetric": n_typed(v.SYMMETRIC, of=of),
        },
        "documentation": {
            "classes_labelled": has(c, LABELS, of), "classes_labelled_pct": (has(c, LABELS, of), f"SELECT count(*) FROM {c}"), "classes_documented": has(c, DEFINITIONS, of),
            "classes_documented_pct": (has(c, DEFINITIONS, of), f"SELECT count(*) FROM {c}"), "properties_labelled": has(q, LABELS, of), "properties_labelled_pct": (has(q, LABELS, of), f"SELECT count(*) FROM {q}"),
        },
    }


for _n, _m in stats_sql().items():
    sql(f"stats_{_n}", long_sql(_n, _m))


def class_edges_sql(t: str = "", of: str = "g", c: str = "c") -> str:
    """Subclass edges among classes, those outside cycles, and longest depths; names end in ``t``."""
    return f"""ce{t} AS (SELECT DISTINCT s AS src, o AS dst FROM {of} WHERE p = '{v.SUBCLASS}' AND s IN (SELECT uri FROM {c}) AND o IN (SELECT uri FROM {c})),
cup{t} AS (SELECT src, dst FROM ce{t} UNION SELECT cup{t}.src, ce{t}.dst FROM cup{t} JOIN ce{t} ON cup{t}.dst = ce{t}.src),
ac{t} AS (SELECT src, dst FROM ce{t} WHERE NOT EXISTS (SELECT 1 FROM cup{t} WHERE cup{t}.src = ce{t}.dst AND cup{t}.dst = ce{t}.src)),
lv{t} AS (SELECT uri, 0 AS depth FROM {c} WHERE uri NOT IN (SELECT src FROM ac{t}) UNION SELECT ac{t}.src, lv{t}.depth + 1 FROM lv{t} JOIN ac{t} ON ac{t}.dst = lv{t}.uri),
ld{t} AS (SELECT uri, max(depth) AS depth FROM lv{t} GROUP BY uri),
rf{t} AS (SELECT o AS uri, count(*) AS n FROM {of} WHERE p IN {_in(v.DOMAIN, v.RANGE)} GROUP BY o),
cn{t} AS (SELECT uri, coalesce(n, 0) AS n FROM {c} LEFT JOIN rf{t} USING (uri)),
"""


def more_stats_sql(t: str = "", of: str = "g", c: str = "c") -> dict[str, dict]:
    no_parent, no_child = f"uri NOT IN (SELECT src FROM ce{t})", f"uri NOT IN (SELECT dst FROM ce{t})"
    refs = f"SELECT count(*) FROM {of} WHERE p IN {_in(v.DOMAIN, v.RANGE)} AND o IN (SELECT uri FROM {c})"
    supers = f"FROM {of} WHERE p = '{v.SUBCLASS}' AND o_kind = 'iri' AND s IN (SELECT uri FROM {c})"
    return {
        "hierarchy": {
            "root_classes": f"SELECT count(*) FROM {c} WHERE {no_parent}", "leaf_classes": f"SELECT count(*) FROM {c} WHERE {no_child}", "max_depth": f"SELECT max(depth) FROM ld{t}",
            "avg_depth": (f"SELECT sum(depth) FROM ld{t}", f"SELECT count(*) FROM ld{t}"), "avg_branching": (f"SELECT count(*) FROM ce{t}", f"SELECT count(DISTINCT dst) FROM ce{t}"),
            "orphan_classes": f"SELECT count(*) FROM {c} WHERE {no_parent} AND {no_child}", "orphan_rate": (f"SELECT count(*) FROM {c} WHERE {no_parent} AND {no_child}", f"SELECT count(*) FROM {c}"),
        },
        "complexity": {
            "avg_properties_per_class": (refs, f"SELECT count(*) FROM {c}"), "avg_superclasses_per_class": (f"SELECT count(*) {supers}", f"SELECT count(*) FROM {c}"),
            "multiple_inheritance_count": f"SELECT count(*) FROM (SELECT s {supers} GROUP BY s HAVING count(*) >= 2)",
            "owl_restriction_count": n_typed(v.RESTRICTION, of=of), "owl_equivalent_count": f"SELECT count(*) FROM {of} WHERE p = '{v.EQUIVALENT_CLASS}'",
        },
        "connectivity": {"most_connected_count": f"SELECT max(n) FROM cn{t}", "isolated_classes": f"SELECT count(*) FROM cn{t} WHERE n = 0"},
    }


CE = class_edges_sql()
for _n, _m in more_stats_sql().items():
    sql(f"stats_{_n}", CE + "x AS (SELECT 1) " + long_sql(_n, _m))
sql("stats_most_connected", CE + "x AS (SELECT 1) SELECT (SELECT uri FROM cn WHERE n > 0 ORDER BY n DESC, uri LIMIT 1) AS most_connected_class, max(n) AS most_connected_count, CAST(count(*) FILTER (WHERE n = 0) AS BIGINT) AS isolated_classes FROM cn")
_kind2 = f"c2 AS (SELECT DISTINCT s AS uri FROM h WHERE p = '{v.TYPE}' AND o IN {_in(*CLASS_TYPES)}), q2 AS (SELECT DISTINCT s AS uri FROM h WHERE p = '{v.TYPE}' AND o IN {_in(*PROPERTY_TYPES)}), {class_edges_sql()} {class_edges_sql('2', 'h', 'c2')}"
_old = " UNION ALL ".join(long_sql(n, m) for n, m in (stats_sql() | more_stats_sql()).items())
_new = " UNION ALL ".join(long_sql(n, m) for n, m in (stats_sql("h", "c2", "q2") | more_stats_sql("2", "h", "c2")).items())
sql("stats_compare", f"""{_kind2} a AS ({_old}), b AS ({_new}),
d AS (SELECT category, metric, CASE WHEN a.den > 0 THEN a.num / a.den ELSE 0.0 END AS old, CASE WHEN b.den > 0 THEN b.num / b.den ELSE 0.0 END AS new FROM a JOIN b USING (category, metric))
SELECT category, metric, CAST(old AS DOUBLE) AS old, CAST(new AS DOUBLE) AS new, new - old AS delta, CASE WHEN old <> 0 THEN (new - old) / old * 100 END AS pct_change,
CASE WHEN category || '.' || metric IN {_in(*BETTER_HIGH)} THEN new > old WHEN category || '.' || metric IN {_in(*BETTER_LOW)} THEN new < old END AS improved
FROM d WHERE new <> old""", True)
sql("class_depths", CE + "x AS (SELECT 1) SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM ld GROUP BY depth")

# traversal


def walk_sql(start: str, most: int | None = None, edges: str = "e") -> str:
    limit = f"WHERE w.depth < {most}" if most else "WHERE w.depth < 50"
    return f"w AS ({start} UNION SELECT x.src, w.depth + 1 FROM w JOIN {edges} x ON x.dst = w.uri {limit})"


sql("descendants", walk_sql(f"SELECT * FROM (VALUES ('{EX}Region_0', 0), ('{EX}Region_3', 0)) AS t(uri, depth)") + " SELECT uri, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY uri")
sql("descendants_depth2", walk_sql(f"SELECT '{EX}Entity' AS uri, 0 AS depth", 2) + " SELECT uri, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY uri")
sql("ancestors", "d AS (SELECT src, dst, 1 AS k FROM e UNION SELECT d.src, e.dst, k + 1 FROM d JOIN e ON d.dst = e.src WHERE k < 12), m AS (SELECT src, dst, min(k) AS k FROM d GROUP BY src, dst) SELECT src, count(*) AS n, CAST(max(k) AS BIGINT) AS far FROM m GROUP BY src")
sql("cycle_members", "SELECT src AS uri FROM up WHERE src = dst")
_roots = f"SELECT uri, 0 AS depth FROM ci WHERE uri NOT IN (SELECT src FROM e WHERE dst NOT IN {_in(*TOPS)})"
sql("bfs_depth", f"ie AS (SELECT src, dst FROM e WHERE src IN (SELECT uri FROM ci) AND dst IN (SELECT uri FROM ci)), {walk_sql(_roots, edges='ie')} SELECT uri, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY uri")
LIST = f"li AS (SELECT o AS head, o AS cell, 0 AS position FROM g WHERE p = '{v.ONE_OF}' UNION SELECT li.head, g.o, li.position + 1 FROM li JOIN g ON g.s = li.cell AND g.p = '{v.REST}' AND g.o <> '{v.NIL}')"
sql("list_items", f"{LIST} SELECT head, CAST(position AS BIGINT) AS position, g.o FROM li JOIN g ON g.s = li.cell AND g.p = '{v.FIRST}'")
PUP = f"pe AS (SELECT s AS src, o AS dst FROM g WHERE p = '{v.SUBPROPERTY}'), pup AS (SELECT src, dst FROM pe UNION SELECT pup.src, pe.dst FROM pup JOIN pe ON pup.dst = pe.src), op AS (SELECT s AS uri FROM g WHERE p = '{v.TYPE}' AND o = '{v.OBJECT_PROPERTY}'), "


def given(p: str) -> str:
    return f"(uri IN (SELECT s FROM g WHERE p = '{p}') OR uri IN (SELECT src FROM pup WHERE dst IN (SELECT s FROM g WHERE p = '{p}')))"


sql("inherited_domain", f"{PUP} x AS (SELECT 1) SELECT uri FROM op WHERE {given(v.DOMAIN)}")
sql("inherited_properties", f"d AS (SELECT s AS property, o AS cls FROM g WHERE p = '{v.DOMAIN}'), i AS (SELECT DISTINCT up.src AS class, d.property FROM up JOIN d ON up.dst = d.cls WHERE up.src <> up.dst AND NOT EXISTS (SELECT 1 FROM d d2 WHERE d2.cls = up.src AND d2.property = d.property)) SELECT class, count(*) AS n, min(property) AS first_property FROM i GROUP BY class")

# lint
ISSUES = {
    "orphan-class": ("error", f"SELECT uri AS entity, '' AS detail FROM ci WHERE NOT {BUILTIN} AND uri NOT IN (SELECT src FROM e)"),
    "dangling-reference": ("error", f"SELECT uri AS entity, '' AS detail FROM ({NODE3}) WHERE NOT {BUILTIN} AND uri NOT IN (SELECT s FROM g WHERE p = '{v.TYPE}') AND {ns('uri')} IN (SELECT {ns('s')} FROM g WHERE p = '{v.TYPE}' AND s_kind = 'iri')"),
    "circular-subclass": ("error", "SELECT src AS entity, '' AS detail FROM up WHERE src = dst AND src IN (SELECT uri FROM ci)"),
    "property-no-type": ("error", f"SELECT s AS entity, 'domain' AS detail FROM g WHERE p = '{v.DOMAIN}' AND s NOT IN (SELECT uri FROM q) UNION ALL SELECT s, 'range' FROM g WHERE p = '{v.RANGE}' AND s NOT IN (SELECT uri FROM q) AND s NOT IN (SELECT s FROM g WHERE p = '{v.DOMAIN}')"),
    "empty-ontology": ("error", f"SELECT s AS entity, '' AS detail FROM g WHERE p = '{v.TYPE}' AND o = '{v.ONTOLOGY}' AND s NOT IN (SELECT s FROM g WHERE p IN {_in(*HEADER_NOTES)})"),
    "missing-label": ("warning", f"SELECT uri AS entity, 'class' AS detail FROM ci WHERE uri NOT IN (SELECT s FROM g WHERE p = '{v.LABEL}') UNION ALL SELECT uri, 'property' FROM q WHERE uri NOT IN (SELECT s FROM g WHERE p = '{v.LABEL}')"),
    "missing-comment": ("warning", f"SELECT uri AS entity, 'class' AS detail FROM ci WHERE uri NOT IN (SELECT s FROM g WHERE p = '{v.COMMENT}') UNION ALL SELECT uri, 'property' FROM q WHERE uri NOT IN (SELECT s FROM g WHERE p = '{v.COMMENT}')"),
    "redundant-subclass": ("info", "SELECT DISTINCT a.src AS entity, a.dst || ' ' || b.dst AS detail FROM e a JOIN e b ON a.src = b.src AND a.dst < b.dst WHERE a.src IN (SELECT uri FROM ci) AND (EXISTS (SELECT 1 FROM up WHERE up.src = a.dst AND up.dst = b.dst) OR EXISTS (SELECT 1 FROM up WHERE up.src = b.dst AND up.dst = a.dst))"),
    "property-no-domain": ("info", f"SELECT uri AS entity, '' AS detail FROM op WHERE NOT {given(v.DOMAIN)}"),
    "property-no-range": ("info", f"SELECT uri AS entity, '' AS detail FROM op WHERE NOT {given(v.RANGE)}"),
    "inconsistent-naming": ("info", f"SELECT uri AS entity, 'class' AS detail FROM ci WHERE regexp_matches({local('uri')}, '^[a-z]') UNION ALL SELECT uri, 'property' FROM q WHERE regexp_matches({local('uri')}, '^[A-Z]')"),
}
for _n, (_s, _b) in ISSUES.items():
    sql("lint_" + _n.replace("-", "_"), f"{PUP} x AS ({_b}) SELECT '{_n}' AS rule_id, '{_s}' AS severity, entity, detail FROM x")
_all = " UNION ALL ".join(f"SELECT '{'warning' if n == 'inconsistent-naming' else s}' AS severity, entity FROM ({b})" for n, (s, b) in ISSUES.items() if n != "missing-comment")
sql("lint_summary", f"{PUP} x AS ({_all}) SELECT severity, count(*) AS n FROM x GROUP BY severity")
sql("lint_exit_code", "SELECT CAST(2 AS BIGINT) AS exit_code")

# differences
T = "s, s_kind, p, o, o_kind, o_dt, o_lang"
DIFF = f"dt AS (SELECT 'added' AS change, * FROM (SELECT {T} FROM h EXCEPT SELECT {T} FROM g) UNION ALL SELECT 'removed', * FROM (SELECT {T} FROM g EXCEPT SELECT {T} FROM h))"
sql("diff_triples", f"{DIFF} SELECT change, s, p, o FROM dt WHERE p <> '{v.COMMENT}'", True)
ENT = f"""{DIFF}, ch AS (SELECT s AS uri, CAST(count(*) FILTER (WHERE change = 'added') AS BIGINT) AS n_added, CAST(count(*) FILTER (WHERE change = 'removed') AS BIGINT) AS n_removed FROM dt WHERE s_kind = 'iri' GROUP BY s),
ga AS (SELECT s AS uri, min({RANK}) AS k, min(o) FILTER (WHERE p = '{v.LABEL}') AS a, min(o) FILTER (WHERE p = '{v.PREF_LABEL}') AS b FROM g GROUP BY s), ha AS (SELECT s AS uri, min({RANK}) AS k, min(o) FILTER (WHERE p = '{v.LABEL}') AS a, min(o) FILTER (WHERE p = '{v.PREF_LABEL}') AS b FROM h GROUP BY s),
de AS (SELECT ch.uri, CASE WHEN ga.uri IS NULL THEN 'added' WHEN ha.uri IS NULL THEN 'removed' ELSE 'modified' END AS change_type, {RANK_NAME.format(x='CASE WHEN ha.uri IS NULL THEN ga.k ELSE ha.k END')} AS entity_type,
CASE WHEN ha.uri IS NULL THEN coalesce(ga.a, ga.b, {local('ch.uri')}) ELSE coalesce(ha.a, ha.b, {local('ch.uri')}) END AS label, n_added, n_removed FROM ch LEFT JOIN ga USING (uri) LEFT JOIN ha USING (uri))"""
sql("diff_entities", f"{ENT} SELECT * FROM de", True)
sql("diff_summary", f"{ENT} SELECT change_type, entity_type, count(*) AS n FROM de WHERE change_type <> 'removed' AND entity_type IN ('class', 'object_property', 'datatype_property', 'annotation_property') GROUP BY ALL", True)
sql("diff_categories", f"{DIFF} SELECT change, {CATEGORY} AS category, count(*) AS n FROM dt GROUP BY ALL", True)
sql("diff_superclasses", "SELECT src AS uri, string_agg(DISTINCT dst, ' ' ORDER BY dst) AS supers FROM e GROUP BY src")

# description
USE = "nu AS (SELECT s AS uri FROM g WHERE s_kind = 'iri' UNION ALL SELECT p FROM g UNION ALL SELECT o FROM g WHERE o_kind = 'iri')"
sql("namespace_usage", f"{USE} SELECT {ns('uri')} AS ns, count(*) AS n FROM nu GROUP BY 1")
sql("namespace_categories", f"{USE}, l AS (SELECT {ns('uri')} AS ns, count(*) AS n FROM ci GROUP BY 1 ORDER BY n DESC, ns LIMIT 1) SELECT {ns('uri')} AS ns, count(*) AS n, CASE WHEN {ns('uri')} IN (SELECT ns FROM l) THEN 'local' ELSE 'external' END AS category FROM nu GROUP BY 1, 3")
_types, _preds = _in(*EXPRESSIVE, *BASIC, *TRAITS), _in(*EXPRESSIVE, v.INVERSE_OF, v.SUBCLASS, v.SUBPROPERTY, v.DOMAIN, v.RANGE)
CONSTRUCTS = f"cc AS (SELECT o AS construct, count(*) AS n FROM g WHERE p = '{v.TYPE}' AND o IN {_types} GROUP BY o UNION ALL SELECT p, count(*) FROM g WHERE p IN {_preds} GROUP BY p)"
sql("owl_construct_counts", f"{CONSTRUCTS} SELECT construct, n FROM cc")
_sum = lambda xs: f"CAST((SELECT count(*) FROM cc WHERE construct IN {_in(*xs)}) AS BIGINT)"
sql("owl_profile", f"""{CONSTRUCTS}, fi AS (SELECT DISTINCT s FROM g WHERE p = '{v.TYPE}' AND o NOT IN {_in(*CLASS_TYPES, v.NAMED_INDIVIDUAL)} AND s IN (SELECT uri FROM c) AND o IN (SELECT uri FROM c)),
k AS (SELECT (SELECT count(*) FROM fi) AS "full", {_sum(EXPRESSIVE)} AS expressive, {_sum([*BASIC, *TRAITS, v.INVERSE_OF])} AS basic, {_sum([v.SUBCLASS, v.SUBPROPERTY, v.DOMAIN, v.RANGE])} AS rdfs)
SELECT CASE WHEN "full" > 0 THEN 'owl_full' WHEN expressive > 0 THEN 'owl_dl_expressive' WHEN basic > 0 THEN 'owl_dl_simple' WHEN rdfs > 0 THEN 'rdfs' ELSE 'rdf' END AS profile, * FROM k""")
_cov = lambda n, k: f"SELECT '{n}' AS kind, count(*) AS total, CAST(count(*) FILTER (WHERE uri IN (SELECT s FROM g WHERE p IN {_in(*LABELS)})) AS BIGINT) AS labelled, CAST(count(*) FILTER (WHERE uri IN (SELECT s FROM g WHERE p IN {_in(*DEFINITIONS)})) AS BIGINT) AS documented FROM {k}"
sql("doc_coverage", f"{_cov('class', 'ci')} UNION ALL {_cov('property', 'q')}")


def best(preds: list[str]) -> str:
    rank = "CASE p " + " ".join(f"WHEN '{p}' THEN {k}" for k, p in enumerate(preds)) + " END"
    return f"SELECT s AS uri, o AS x FROM g WHERE p IN {_in(*preds)} AND o_kind = 'literal' QUALIFY row_number() OVER (PARTITION BY s ORDER BY o_lang NOT IN ('en', ''), {rank}, o) = 1"


BEST = f"bl AS ({best(LABELS)}), bd AS ({best(DEFINITIONS)})"
sql("best_labels", f"{BEST} SELECT uri, bl.x AS label, bd.x AS definition FROM bl FULL JOIN bd USING (uri)")
_li = "SELECT o FROM g WHERE s = h.uri AND p = '{}license'"
sql("ontology_metadata", f"""h AS (SELECT min(s) AS uri FROM g WHERE p = '{v.TYPE}' AND o = '{v.ONTOLOGY}' AND s_kind = 'iri')
SELECT uri, coalesce((SELECT min(o) FROM g WHERE s = h.uri AND p = '{v.LABEL}'), (SELECT min(o) FROM g WHERE s = h.uri AND p = '{v.DCTERMS}title'), (SELECT min(o) FROM g WHERE s = h.uri AND p = 'http://purl.org/dc/elements/1.1/title')) AS title,
(SELECT min(o) FROM g WHERE s = h.uri AND p = '{v.COMMENT}') AS description, (SELECT min(o) FROM g WHERE s = h.uri AND p = '{v.OWL}versionInfo') AS version, (SELECT count(*) FROM g WHERE s = h.uri AND p = '{v.IMPORTS}') AS n_imports,
({_li.format(v.DCTERMS)}) AS license, (SELECT min(o) FROM g WHERE p = '{v.LABEL}' AND s IN ({_li.format(v.DCTERMS)})) AS license_label,
(SELECT string_agg(DISTINCT l.o, ', ' ORDER BY l.o) FROM g c JOIN g l ON l.s = c.o AND l.p = '{v.LABEL}' WHERE c.s = h.uri AND c.p = '{v.DCTERMS}creator') AS creators FROM h""")
sql("describe_metrics", f"""rp AS (SELECT DISTINCT s FROM g WHERE p = '{v.TYPE}' AND o = '{v.RDF_PROPERTY}' AND s NOT IN ({n_typed(v.OBJECT_PROPERTY, v.DATATYPE_PROPERTY, v.ANNOTATION_PROPERTY).replace('count(DISTINCT s)', 's')}))
SELECT 'total_triples' AS metric, count(*) AS n FROM g UNION ALL SELECT 'classes', count(*) FROM c UNION ALL SELECT 'object_properties', ({n_typed(v.OBJECT_PROPERTY)}) UNION ALL SELECT 'datatype_properties', ({n_typed(v.DATATYPE_PROPERTY)})
UNION ALL SELECT 'annotation_properties', ({n_typed(v.ANNOTATION_PROPERTY)}) UNION ALL SELECT 'rdf_properties', count(*) FROM rp UNION ALL SELECT 'individuals', count(DISTINCT s) FROM g WHERE p = '{v.TYPE}' AND s NOT IN ({KNOWN})""")
ORACLE_SQL["owl_profile_text"] = f"SELECT profile, CASE profile WHEN 'owl_dl_expressive' THEN 'OWL 2 DL (expressive)' END AS display, CASE profile WHEN 'owl_dl_expressive' THEN 'Full DL reasoning; may be computationally expensive' END AS guidance FROM ({ORACLE_SQL['owl_profile']})"
sql("top_roots", "SELECT uri FROM ci WHERE uri NOT IN (SELECT src FROM e) ORDER BY uri LIMIT 10")

# merging
MG = f"m AS (SELECT {T}, 1 AS priority, 0 AS ord FROM g UNION ALL SELECT {T}, 5, 1 FROM h)"


def conflict_sql(where: str) -> str:
    return f"""{MG}, v AS (SELECT {T}, max(priority) AS priority, min(ord) AS first, max(ord) AS last, concat_ws(chr(31), o, o_kind, o_dt, o_lang) AS term FROM m WHERE s_kind = 'iri' AND {where} GROUP BY ALL),
cf AS (SELECT s, p, CASE WHEN p = '{v.TYPE}' THEN 'type' WHEN p IN {_in(v.SUBCLASS, v.SUBPROPERTY)} THEN 'hierarchy' WHEN p IN {_in(v.DISJOINT, v.EQUIVALENT_CLASS)} THEN 'contradiction' ELSE 'value' END AS conflict_type, count(*) AS n_values FROM v GROUP BY s, p HAVING count(*) > 1)"""


_some = f"p NOT IN {_in(v.COMMENT, EX + 'contains')}"
sql("merge_union", f"SELECT p, count(*) AS n FROM (SELECT {T} FROM g UNION SELECT {T} FROM h) GROUP BY p", True)
sql("merge_conflicts_ignoring", f"{conflict_sql(_some)} SELECT s, p, conflict_type, n_values FROM cf", True)
sql("merge_conflicts", f"{conflict_sql('true')} SELECT s, p, conflict_type, n_values FROM cf", True)
sql("merge_semantic_conflicts", f"{conflict_sql('true')} SELECT s, p, conflict_type, n_values FROM cf WHERE conflict_type IN ('hierarchy', 'contradiction')", True)
for _n, _o in (("priority", "priority DESC, first, term"), ("first", "first, term"), ("last", "last DESC, term")):
    sql(f"merge_resolve_{_n}", f"{conflict_sql('true')} SELECT v.s, v.p, v.o AS winner FROM v JOIN cf USING (s, p) WHERE conflict_type = 'value' QUALIFY row_number() OVER (PARTITION BY v.s, v.p ORDER BY {_o}) = 1", True)
_lab = f"p = '{v.LABEL}'"
sql("merge_resolved_graph", f"{conflict_sql('true')}, wi AS (SELECT v.s, v.p, v.o AS winner FROM v JOIN cf USING (s, p) QUALIFY row_number() OVER (PARTITION BY v.s, v.p ORDER BY priority DESC, first, term) = 1) SELECT d.s, d.p, d.o FROM (SELECT DISTINCT {T} FROM m) d LEFT JOIN wi USING (s, p) WHERE winner IS NULL OR winner = d.o", True)
sql("merge_authoritative", f"SELECT s, p, o, o_lang FROM (SELECT {T} FROM h UNION SELECT {T} FROM g WHERE NOT ({_lab}) OR s NOT IN (SELECT s FROM h WHERE {_lab}))", True)

# refactoring
NEW = "http://example.org/v2#"
ren = lambda x, kind: f"CASE WHEN {kind} AND starts_with({x}, '{EX}type_') THEN '{NEW}kind-' || substr({x}, {len(EX + 'type_') + 1}) WHEN {kind} AND starts_with({x}, '{EX}') THEN '{NEW}' || substr({x}, {len(EX) + 1}) ELSE {x} END"
sql("rename_namespace", f"r AS (SELECT DISTINCT {ren('s', '''s_kind = 'iri' ''')} AS s, {ren('p', 'true')} AS p, {ren('o', '''o_kind = 'iri' ''')} AS o, s_kind, o_kind, o_dt, o_lang FROM g) SELECT {ns('s')} AS ns, p, count(*) AS n, max(o) AS last_o FROM r GROUP BY ALL")
MP = f"mp AS (SELECT uri AS old, replace(uri, '#Customer_', '#Client_') AS new FROM ci WHERE contains(uri, '#Customer_') UNION ALL SELECT '{EX}status', '{EX}state'),"
sql("rename_entities", f"{MP} r AS (SELECT DISTINCT coalesce(a.new, g.s) AS s, coalesce(b.new, g.p) AS p, coalesce(d.new, g.o) AS o, s_kind, o_kind, o_dt, o_lang FROM g LEFT JOIN mp a ON a.old = g.s AND s_kind = 'iri' LEFT JOIN mp b ON b.old = g.p LEFT JOIN mp d ON d.old = g.o AND o_kind = 'iri') SELECT s, p, o FROM r WHERE contains(s, '#Client_') OR contains(o, '#Client_') OR p LIKE '%state'")
sql("rename_stats", f"{MP} r AS (SELECT 'subject' AS position, s AS x FROM g WHERE s_kind = 'iri' UNION ALL SELECT 'predicate', p FROM g UNION ALL SELECT 'object', o FROM g WHERE o_kind = 'iri') SELECT position, count(*) AS n FROM r WHERE x IN (SELECT old FROM mp) GROUP BY position")
sql("rename_literal_mentions", "SELECT name, count(*) AS n FROM g JOIN (VALUES ('Customer'), ('NATION'), ('of B')) AS t(name) ON contains(o, name) WHERE o_kind = 'literal' GROUP BY name")
sql("deprecate_bulk", f"""SELECT s, p, o, o_lang FROM g WHERE s IN {_in(EX + 'Segment_BUILDING', EX + 'Customer_0', EX + 'Nowhere')}
UNION ALL VALUES ('{EX}Segment_BUILDING', '{v.DEPRECATED}', 'true', ''), ('{EX}Segment_BUILDING', '{v.REPLACED_BY}', '{EX}Segment_HOUSEHOLD', ''), ('{EX}Segment_BUILDING', '{v.COMMENT}', 'DEPRECATED in 2.0: use households', 'en'),
('{EX}Customer_0', '{v.DEPRECATED}', 'true', ''), ('{EX}Customer_0', '{v.COMMENT}', 'DEPRECATED: gone', 'en')""")
sql("migrate_uri_map", f"SELECT p, o_kind = 'iri' AND contains(o, '#Customer_') AS mapped, count(*) AS n FROM g GROUP BY ALL")
sql("migrate_strbefore", f"m AS (SELECT s, o FROM g WHERE p = '{v.COMMENT}' AND contains(o, ' of ')) SELECT DISTINCT s, '{EX}before' AS p, split_part(o, ' of ', 1) AS o FROM m UNION SELECT s, '{EX}after', substr(o, instr(o, ' of ') + 4) FROM m")
sql("migrate_arith", f"SELECT DISTINCT s, p, o, o_dt FROM g WHERE p <> '{EX}totalPrice' UNION ALL SELECT DISTINCT s, '{EX}net' AS p, CAST(CAST((CAST(o AS DECIMAL(18,2)) - 10.00) * 0.80 AS DECIMAL(18,2)) AS VARCHAR) AS o, '{v.XSD}decimal' AS o_dt FROM g WHERE p = '{EX}totalPrice'")

# splitting
ASSIGN = f"""kn AS (SELECT uri, 'class' AS kind FROM ci UNION ALL SELECT uri, 'property' FROM q WHERE uri NOT IN (SELECT uri FROM ci)), {walk_sql(f"SELECT '{EX}Region_1' AS uri, 0 AS depth")},
cl AS (SELECT '{EX}Region_1' AS uri, 0 AS step, 0 AS ord, 'nations' AS module UNION ALL SELECT uri, 0, 1, 'segments' FROM kn WHERE uri IN {_in(EX + 'Segment_BUILDING', EX + 'Segment_MACHINERY', EX + 'status')}
UNION ALL SELECT uri, 1, 0, 'nations' FROM w WHERE depth > 0 UNION ALL SELECT uri, 2, 2, 'supply' FROM kn WHERE starts_with(uri, '{EX}supplies_') OR starts_with(uri, '{EX}type_')),
bs AS (SELECT uri, module FROM cl QUALIFY row_number() OVER (PARTITION BY uri ORDER BY step, ord) = 1), asg AS (SELECT kn.uri, coalesce(module, 'common') AS module, kind FROM kn LEFT JOIN bs USING (uri))"""
sql("split_assign", f"{ASSIGN} SELECT uri, module, kind FROM asg")
sql("split_by_namespace", f"SELECT {ns('uri')} AS module, count(*) AS n FROM (SELECT uri FROM ci UNION SELECT uri FROM q) GROUP BY 1")
sql("split_dependencies", f"{ASSIGN} SELECT a.module, b.module AS needs, count(*) AS n FROM g JOIN asg a ON g.s = a.uri JOIN asg b ON g.o = b.uri AND g.o_kind = 'iri' WHERE a.module <> b.module GROUP BY ALL")
sql("split_module_stats", f"{ASSIGN} SELECT module, CAST(count(*) FILTER (WHERE kind = 'class') AS BIGINT) AS classes, CAST(count(*) FILTER (WHERE kind = 'property') AS BIGINT) AS properties, (SELECT count(*) FROM g JOIN asg b ON g.s = b.uri WHERE b.module = asg.module) AS triples FROM asg GROUP BY module")
sql("split_data", f"{ASSIGN}, hm AS (SELECT DISTINCT g.s, asg.module FROM g JOIN asg ON g.o = asg.uri AND asg.kind = 'class' WHERE p = '{v.TYPE}' AND g.s NOT IN (SELECT uri FROM asg)) SELECT module, p, count(*) AS n FROM g JOIN hm USING (s) GROUP BY ALL")

# translation
TEXTS = [v.LABEL, v.COMMENT, v.PREF_LABEL, v.DEFINITION]
KINDS = [v.OWL_CLASS, v.RDFS_CLASS, v.OBJECT_PROPERTY, v.DATATYPE_PROPERTY, v.ANNOTATION_PROPERTY, v.NAMED_INDIVIDUAL]
_kr = "CASE o " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
LOC = f"en AS (SELECT s AS uri, o AS type FROM g WHERE p = '{v.TYPE}' AND s_kind = 'iri' AND o IN {_in(*KINDS)} QUALIFY row_number() OVER (PARTITION BY s ORDER BY {_kr}) = 1), tx AS (SELECT s AS uri, p AS property, o, CASE WHEN o_lang = '' THEN 'en' ELSE o_lang END AS lang FROM g WHERE o_kind = 'literal' AND p IN {_in(*TEXTS)} AND s IN (SELECT uri FROM en))"
EXTRACT = "SELECT a.uri, type, a.property, a.o AS source, coalesce(t, '') AS translation, CASE WHEN t IS NULL THEN 'pending' ELSE 'translated' END AS status FROM tx a JOIN en USING (uri) LEFT JOIN (SELECT uri, property, min(o) AS t FROM tx WHERE lang = '{}' GROUP BY ALL) b ON a.uri = b.uri AND a.property = b.property WHERE a.lang = 'en'"
sql("localise_extract", f"{LOC} {EXTRACT.format('de')}")
sql("localise_status", f"{LOC} SELECT status, count(*) AS n FROM ({EXTRACT.format('es')}) GROUP BY status")
sql("localise_missing", f"{LOC} SELECT DISTINCT uri FROM tx WHERE lang = 'en' AND uri NOT IN (SELECT uri FROM tx WHERE lang = 'fr')")
sql("localise_coverage", f"{LOC} SELECT language, property, count(DISTINCT uri) FILTER (WHERE lang = 'en') AS total, count(DISTINCT uri) FILTER (WHERE lang = language) AS translated FROM tx CROSS JOIN (VALUES ('de'), ('fr'), ('es'), ('en')) AS l(language) GROUP BY ALL")
sql("localise_merge", f"""{LOC}, tr AS (SELECT a.uri, a.property, a.o FROM tx a WHERE lang = 'en' AND length(o) % 2 = 0 AND NOT EXISTS (SELECT 1 FROM tx b WHERE b.uri = a.uri AND b.property = a.property AND b.lang = 'de')),
r AS (SELECT s, p, o, o_lang, o_kind, o_dt FROM g WHERE o_kind = 'literal' UNION SELECT uri, property, o || ' (de)', 'de', 'literal', '' FROM tr) SELECT p, o_lang, count(*) AS n, max(o) AS last FROM r GROUP BY ALL""")

# shapes
SHD = f"sr AS (SELECT d.o AS class, d.s AS path, r.range FROM g d LEFT JOIN (SELECT s, min(o) AS range FROM g WHERE p = '{v.RANGE}' AND o_kind = 'iri' GROUP BY s) r ON r.s = d.s WHERE d.p = '{v.DOMAIN}'), sd AS (SELECT class, path, CASE WHEN starts_with(range, '{v.XSD}') THEN range END AS datatype, CASE WHEN NOT starts_with(range, '{v.XSD}') THEN range END AS node_class FROM sr)"
_val = lambda p: f"(SELECT min(o) FROM g x WHERE x.s = u.o AND x.p = '{p}')"
_num = lambda n: f"nullif(try_cast({_val(v.OWL + n)} AS INT), 0)"
SHC = f"""sc AS (SELECT * FROM (SELECT u.s AS class, {_val(v.ON_PROPERTY)} AS path, CASE WHEN {_val(v.SOME_VALUES)} IS NOT NULL THEN 1 ELSE coalesce({_num('minQualifiedCardinality')}, {_num('qualifiedCardinality')}, {_num('minCardinality')}) END AS min_count,
coalesce({_num('maxQualifiedCardinality')}, {_num('qualifiedCardinality')}, {_num('maxCardinality')}) AS max_count,
coalesce({_val(v.SOME_VALUES)}, CASE WHEN coalesce({_num('minQualifiedCardinality')}, {_num('maxQualifiedCardinality')}, {_num('qualifiedCardinality')}) IS NOT NULL THEN {_val(v.OWL + 'onClass')} END) AS node_class,
CASE WHEN {_num('qualifiedCardinality')} IS NOT NULL THEN {_val(v.OWL + 'onDataRange')} END AS datatype
FROM g u WHERE u.p = '{v.SUBCLASS}' AND u.o_kind = 'bnode') WHERE coalesce(CAST(min_count AS VARCHAR), CAST(max_count AS VARCHAR), node_class, datatype) IS NOT NULL)"""
SHF = f"sf AS (SELECT o AS class, s AS path FROM g WHERE p = '{v.DOMAIN}' AND s IN (SELECT s FROM g WHERE p = '{v.TYPE}' AND o = '{v.FUNCTIONAL}'))"
SHA = f"""{SHD}, {SHC}, {SHF}, sa AS (SELECT class, path, NULL::INT AS min_count, NULL::INT AS max_count, datatype, node_class, 0 AS step FROM sd UNION ALL SELECT class, path, min_count, max_count, datatype, node_class, 1 FROM sc UNION ALL SELECT class, path, NULL, 1, NULL, NULL, 2 FROM sf),
sx AS (SELECT class, path, max(min_count) AS min_count, min(max_count) AS max_count, max_by(datatype, (step, datatype)) FILTER (WHERE datatype IS NOT NULL) AS datatype, max_by(node_class, (step, node_class)) FILTER (WHERE node_class IS NOT NULL) AS node_class FROM sa WHERE class IN (SELECT uri FROM ci) GROUP BY class, path),
sy AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY path) AS sh_order FROM sx)"""
sql("shacl_domain_range", f"{SHD} SELECT class, path, datatype, node_class FROM sd")
sql("shacl_cardinality", f"{SHC} SELECT class, path, CAST(min_count AS BIGINT) AS min_count, CAST(max_count AS BIGINT) AS max_count, node_class, datatype FROM sc")
sql("shacl_functional", f"{SHF} SELECT class, path FROM sf")
sql("shacl_enumeration", f"{LIST}, it AS (SELECT head, string_agg(g.o, ' ' ORDER BY position) AS items, count(*) AS n FROM li JOIN g ON g.s = li.cell AND g.p = '{v.FIRST}' GROUP BY head) SELECT d.o AS class, d.s AS path, it.n, it.items FROM g d JOIN g r ON r.s = d.s AND r.p = '{v.RANGE}' JOIN g o ON o.s = r.o AND o.p = '{v.ONE_OF}' JOIN it ON it.head = o.o WHERE d.p = '{v.DOMAIN}'")
sql("shacl_property_shapes", f"{SHA} SELECT class, path, CAST(min_count AS BIGINT) AS min_count, CAST(max_count AS BIGINT) AS max_count, datatype, node_class, sh_order FROM sy")
_shape = f"'http://example.org/tpch-shapes#' || {local('class')} || 'Shape'"
_node = "sha256(class || ' ' || path)"
_sh = [(_shape, f"'{v.TYPE}'", f"'{v.SH}NodeShape'"), (_shape, f"'{v.SH}targetClass'", "class"), (_shape, f"'{v.SH}property'", _node), (_node, f"'{v.SH}path'", "path"), (_node, f"'{v.SH}minCount'", "CAST(min_count AS VARCHAR)"), (_node, f"'{v.SH}maxCount'", "CAST(max_count AS VARCHAR)"), (_node, f"'{v.SH}datatype'", "datatype"), (_node, f"'{v.SH}class'", "node_class"), (_node, f"'{v.SH}order'", "CAST(sh_order AS VARCHAR)")]
sql("shacl_shapes", f"{SHA}, st AS ({' UNION '.join(f'SELECT {a} AS s, {b} AS p, {c} AS o FROM sy' for a, b, c in _sh)}) SELECT p, count(*) AS n, max(o) AS last FROM st WHERE o IS NOT NULL GROUP BY p")
sql("shacl_inherited", f"""{SHA}, dd AS (SELECT src, dst, 1 AS k FROM e UNION SELECT dd.src, e.dst, k + 1 FROM dd JOIN e ON dd.dst = e.src WHERE k < 12), dm AS (SELECT src, dst, min(k) AS k FROM dd WHERE src <> dst GROUP BY src, dst),
ih AS (SELECT dm.src AS class, sy.path, dm.dst AS from_class FROM dm JOIN sy ON sy.class = dm.dst WHERE NOT EXISTS (SELECT 1 FROM sy s2 WHERE s2.class = dm.src AND s2.path = sy.path) QUALIFY row_number() OVER (PARTITION BY dm.src, sy.path ORDER BY k, dm.dst) = 1)
SELECT class, count(*) AS n, min(from_class) AS first_from FROM ih GROUP BY class""")

# the same with closed lists and inherited constraints: strict, closed
_step = [("SELECT class, path, NULL::INT AS min_count, NULL::INT AS max_count, datatype, node_class, NULL::VARCHAR AS items, 0 AS step FROM sd"), ("SELECT class, path, min_count, max_count, datatype, node_class, NULL, 1 FROM sc"), ("SELECT class, path, NULL, 1, NULL, NULL, NULL, 2 FROM sf"), ("SELECT class, path, NULL, NULL, NULL, NULL, items, 3 FROM en")]
_en = ORACLE_SQL["shacl_enumeration"]
_en = _en[_en.index("li AS (") :]
SHX = f"""{SHD}, {SHC}, {SHF}, {_en[: _en.rindex(' SELECT d.o AS class')]}, en AS ({_en[_en.rindex('SELECT d.o AS class') :]}), pa AS ({' UNION ALL '.join(_step)}),
ha AS (SELECT up.src AS class, pa.path, min_count, max_count, datatype, node_class, items, step FROM up JOIN pa ON up.dst = pa.class WHERE up.src <> up.dst AND NOT EXISTS (SELECT 1 FROM pa o WHERE o.class = up.src AND o.path = pa.path)),
pb AS (SELECT * FROM pa UNION ALL SELECT * FROM ha),
pc AS (SELECT class, path, max(min_count) AS min_count, min(max_count) AS max_count, max_by(datatype, (step, datatype)) FILTER (WHERE datatype IS NOT NULL) AS datatype, max_by(node_class, (step, node_class)) FILTER (WHERE node_class IS NOT NULL) AS node_class, max(items) AS items, min(step) = 0 AS ranged FROM pb WHERE class IN (SELECT uri FROM ci) GROUP BY class, path),
pd AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY path) AS sh_order FROM pc),
tn AS (SELECT s, min(o) AS x FROM g WHERE p = '{v.LABEL}' AND o_kind = 'literal' GROUP BY s), td AS (SELECT s, min(o) AS x FROM g WHERE p = '{v.COMMENT}' AND o_kind = 'literal' GROUP BY s),
it2 AS (SELECT {_node} AS node, unnest(string_split(items, ' ')) AS item, generate_subscripts(string_split(items, ' '), 1) - 1 AS k, len(string_split(items, ' ')) AS n FROM pd WHERE items IS NOT NULL)"""
_sh2 = [x for x in _sh if "NodeShape" not in x[2] and "targetClass" not in x[1]]
_own = "ci LEFT JOIN tn ON tn.s = ci.uri LEFT JOIN td ON td.s = ci.uri"
_cshape = f"'http://example.org/tpch-shapes#' || {local('ci.uri')} || 'Shape'"
_ig = lambda k: f"sha256('ignored ' || uri) || '_{k}'"
sql("shacl_strict_shapes", f"""{SHX}, st AS ({' UNION '.join(f'SELECT {a} AS s, {b} AS p, {c} AS o FROM pd' for a, b, c in _sh2)}
UNION SELECT {_node}, '{v.SH}name', tn.x FROM pd JOIN tn ON tn.s = path WHERE ranged UNION SELECT {_node}, '{v.SH}description', td.x FROM pd JOIN td ON td.s = path WHERE ranged UNION SELECT {_node}, '{v.SH}in', {_node} || '_0' FROM pd WHERE items IS NOT NULL
UNION SELECT {_cshape}, '{v.TYPE}', '{v.SH}NodeShape' FROM {_own} UNION SELECT {_cshape}, '{v.SH}targetClass', uri FROM {_own} UNION SELECT {_cshape}, '{v.SH}name', tn.x FROM {_own} UNION SELECT {_cshape}, '{v.SH}description', td.x FROM {_own}
UNION SELECT {_cshape}, '{v.SH}closed', 'true' FROM ci UNION SELECT {_cshape}, '{v.SH}ignoredProperties', {_ig(0)} FROM ci UNION SELECT {_ig(0)}, '{v.FIRST}', '{v.TYPE}' FROM ci UNION SELECT {_ig(0)}, '{v.REST}', {_ig(1)} FROM ci
UNION SELECT {_ig(1)}, '{v.FIRST}', '{v.LABEL}' FROM ci UNION SELECT {_ig(1)}, '{v.REST}', '{v.NIL}' FROM ci
UNION SELECT node || '_' || k, '{v.FIRST}', item FROM it2 UNION SELECT node || '_' || k, '{v.REST}', CASE WHEN k = n - 1 THEN '{v.NIL}' ELSE node || '_' || (k + 1) END FROM it2)
SELECT p, count(*) AS n, min(s) AS first_s, max(o) AS last_o FROM st WHERE o IS NOT NULL GROUP BY p""")
sql("shacl_namespace", f"SELECT regexp_replace(min(s), '[#/]$', '') || '-shapes#' AS ns FROM g WHERE p = '{v.TYPE}' AND o = '{v.ONTOLOGY}'")

# documentation and diagrams
_cnt = lambda p: f"(SELECT count(*) FROM g WHERE p = '{p}' AND s_kind = 'iri' AND o = ci.uri)"
DOCC = f"""{BEST}, bk AS (SELECT o AS uri, count(*) FILTER (WHERE p = '{v.SUBCLASS}') AS a, count(*) FILTER (WHERE p = '{v.DOMAIN}') AS b, count(*) FILTER (WHERE p = '{v.RANGE}') AS d, count(*) FILTER (WHERE p = '{v.TYPE}') AS f FROM g WHERE s_kind = 'iri' GROUP BY o),
sp AS (SELECT src AS uri, string_agg(DISTINCT dst, ' ' ORDER BY dst) AS supers FROM e GROUP BY src),
dc AS (SELECT ci.uri, coalesce(bl.x, {local('ci.uri')}) AS label, bd.x AS definition, coalesce(supers, '') AS supers, CAST(coalesce(a, 0) AS BIGINT) AS n_subclasses, CAST(coalesce(b, 0) AS BIGINT) AS n_domain_of, CAST(coalesce(d, 0) AS BIGINT) AS n_range_of, CAST(coalesce(f, 0) AS BIGINT) AS n_instances
FROM ci LEFT JOIN bl ON bl.uri = ci.uri LEFT JOIN bd ON bd.uri = ci.uri LEFT JOIN bk ON bk.uri = ci.uri LEFT JOIN sp ON sp.uri = ci.uri)"""
sql("docs_classes", f"{DOCC} SELECT * FROM dc")
_agg = lambda p: f"coalesce((SELECT string_agg(DISTINCT o, ' ' ORDER BY o) FROM g WHERE s = q.uri AND p = '{p}' AND o_kind = 'iri'), '')"
_is = lambda t: f"uri IN (SELECT s FROM g WHERE p = '{v.TYPE}' AND o = '{t}')"
sql("docs_properties", f"SELECT uri, CASE WHEN {_is(v.OBJECT_PROPERTY)} THEN 'object' WHEN {_is(v.DATATYPE_PROPERTY)} THEN 'datatype' WHEN {_is(v.ANNOTATION_PROPERTY)} THEN 'annotation' ELSE 'rdf' END AS kind, {_agg(v.DOMAIN)} AS domains, {_agg(v.RANGE)} AS ranges, {_agg(v.SUBPROPERTY)} AS supers FROM q")
sql("docs_instances", f"SELECT s AS uri, string_agg(DISTINCT o, ' ' ORDER BY o) FILTER (WHERE p = '{v.TYPE}') AS types, CAST(count(*) FILTER (WHERE p <> '{v.TYPE}') AS BIGINT) AS n_values FROM g WHERE s_kind = 'iri' AND s NOT IN ({KNOWN}) AND s IN (SELECT s FROM g WHERE p = '{v.TYPE}') GROUP BY s")
_stop = _in(*STOPPED)
sql("docs_search_keywords", f"""{BEST}, en AS (SELECT uri FROM ci UNION SELECT uri FROM q), k AS (SELECT en.uri, coalesce(bl.x, {local('en.uri')}) AS label, coalesce(bd.x, '') AS def FROM en LEFT JOIN bl ON bl.uri = en.uri LEFT JOIN bd ON bd.uri = en.uri)
SELECT uri, label, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', label, def, {local('uri')})), '[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN {_stop}))), ' ') AS words FROM k""")
sql("docs_markdown", f"{DOCC} SELECT uri, '# ' || label || chr(10) || chr(10) || '`' || uri || '`' || CASE WHEN definition IS NOT NULL THEN chr(10) || chr(10) || definition ELSE '' END || CASE WHEN supers = '' THEN '' ELSE chr(10) || chr(10) || '**Superclasses:** ' || supers END || chr(10) AS page FROM dc")
CH = "ch AS (SELECT uri FROM ci)"
DOMS = f"SELECT DISTINCT s AS uri FROM g WHERE p = '{v.DOMAIN}' AND o IN (SELECT uri FROM ch)"
sql("uml_select_domain_based", f"{CH} {DOMS}")
sql("uml_select_connected", f"{CH} {DOMS} AND s IN (SELECT s FROM g WHERE p = '{v.RANGE}' AND o IN (SELECT uri FROM ch))")
sql("uml_edges", f"{CH} SELECT {local('src')} || ' --|> ' || {local('dst')} AS line FROM e WHERE src IN (SELECT uri FROM ch) AND dst IN (SELECT uri FROM ch) UNION ALL SELECT {local('d.o')} || ' --> ' || {local('r.o')} || ' : ' || {local('d.s')} FROM g d JOIN g r ON r.s = d.s AND r.p = '{v.RANGE}' WHERE d.p = '{v.DOMAIN}' AND d.o IN (SELECT uri FROM ch) AND r.o IN (SELECT uri FROM ch)")
sql("uml_class_lines", f"{CH}, attr AS (SELECT d.o AS uri, string_agg(DISTINCT {local('d.s')} || ' : ' || {local('r.o')}, '; ' ORDER BY {local('d.s')} || ' : ' || {local('r.o')}) AS a FROM g d JOIN g r ON r.s = d.s AND r.p = '{v.RANGE}' AND starts_with(r.o, '{v.XSD}') WHERE d.p = '{v.DOMAIN}' GROUP BY d.o) SELECT 'class ' || {local('ch.uri')} || ' {{' || coalesce(a, '') || '}}' AS line FROM ch LEFT JOIN attr ON attr.uri = ch.uri".replace("{{", "{").replace("}}", "}"))
_esc = "replace(replace(replace(replace(o, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')"
_fmt = f"CASE o_kind WHEN 'iri' THEN {qname('o')} WHEN 'bnode' THEN '_:' || o ELSE '\"' || {_esc} || '\"' || CASE WHEN o_lang <> '' THEN '@' || o_lang WHEN o_dt <> '' THEN '^^' || {qname('o_dt')} ELSE '' END END"
_pp = f"CASE WHEN p = '{v.TYPE}' THEN 'a' ELSE {qname('p')} END"
_place = f"CASE p WHEN '{v.TYPE}' THEN -1 WHEN '{v.SUBCLASS}' THEN 0 WHEN '{v.LABEL}' THEN 1 WHEN '{v.COMMENT}' THEN 20000 ELSE 10000 END"
LINES = "tl AS (SELECT s, CASE WHEN s_kind = 'bnode' THEN '_:' || s ELSE {q} END AS subject, row_number() OVER (PARTITION BY s ORDER BY place, pp) AS ord, pp || ' ' || objects AS line FROM (SELECT s, s_kind, {pp} AS pp, {place} AS place, string_agg(DISTINCT {fmt}, ', ' ORDER BY {fmt}) AS objects FROM g WHERE {w} GROUP BY ALL))"
sql("turtle_lines", LINES.format(q=qname("s"), pp=_pp, place=_place, fmt=_fmt, w="true") + " SELECT subject, ord, line FROM tl")
sql("turtle_blocks", LINES.format(q=qname("s"), pp=_pp, place=_place, fmt=_fmt, w="true") + " SELECT subject, subject || ' ' || string_agg(line, ' ;' || chr(10) || '    ' ORDER BY ord) || ' .' AS block FROM tl GROUP BY subject")
sql("order_sections", f"a AS (SELECT uri, 0 AS k, 'classes' AS section FROM c UNION ALL SELECT s, 1, 'obj_props' FROM g WHERE p = '{v.TYPE}' AND o = '{v.OBJECT_PROPERTY}' UNION ALL SELECT s, 2, 'data_props' FROM g WHERE p = '{v.TYPE}' AND o = '{v.DATATYPE_PROPERTY}' UNION ALL SELECT s, 3, 'ann_props' FROM g WHERE p = '{v.TYPE}' AND o = '{v.ANNOTATION_PROPERTY}' UNION ALL SELECT s, 4, 'individuals' FROM g WHERE s NOT IN (SELECT uri FROM c) AND s NOT IN (SELECT uri FROM q)), b AS (SELECT uri, min_by(section, k) AS section FROM a GROUP BY uri) SELECT section, count(*) AS n, min(uri) AS first_uri FROM b GROUP BY section")
sql("order_topological", CE + f"x AS (SELECT 1) SELECT uri, CAST(depth AS BIGINT) AS level, row_number() OVER (PARTITION BY depth ORDER BY {qname('uri')}) AS place FROM ld")

# graph patterns
sql("bgp_join", f"SELECT a.s AS \"order\", b.s AS customer, b.o AS nation FROM g a JOIN g b ON a.o = b.s JOIN g d ON b.o = d.s WHERE a.p = '{v.TYPE}' AND b.p = '{v.SUBCLASS}' AND d.p = '{v.SUBCLASS}' AND d.o = '{EX}Region_2'")
sql("bgp_optional", f"SELECT a.s AS c, a.o AS nation, b.o AS label FROM g a LEFT JOIN g b ON a.s = b.s AND b.p = '{v.LABEL}' WHERE a.p = '{v.SUBCLASS}' AND contains(a.o, '#Nation_')")
sql("bgp_union", f"SELECT s AS x, NULL AS d FROM g WHERE p = '{v.TYPE}' AND o = '{v.FUNCTIONAL}' UNION ALL SELECT a.s, b.o FROM g a JOIN g b ON a.s = b.s AND b.p = '{v.DOMAIN}' WHERE a.p = '{v.TYPE}' AND a.o = '{v.SYMMETRIC}'")
sql("bgp_minus", f"SELECT s AS c FROM g WHERE p = '{v.TYPE}' AND o = '{v.OWL_CLASS}' AND s NOT IN (SELECT s FROM g WHERE p = '{v.LABEL}')")
sql("bgp_exists", f"SELECT s AS p FROM g WHERE p = '{v.TYPE}' AND o = '{v.OBJECT_PROPERTY}' AND s IN (SELECT s FROM g WHERE p = '{v.RANGE}')")
sql("bgp_group_by", f"SELECT a.o AS customer, count(*) AS orders, CAST(sum(CAST(b.o AS DECIMAL(18,2)))::DECIMAL(18,2) AS VARCHAR) AS total FROM g a JOIN g b ON a.s = b.s AND b.p = '{EX}totalPrice' WHERE a.p = '{v.TYPE}' GROUP BY a.o HAVING count(*) >= 5")
sql("bgp_path_star", f"n AS (SELECT src AS x FROM e UNION SELECT dst FROM e), st AS (SELECT src, dst FROM up UNION SELECT x, x FROM n) SELECT src AS c, dst AS top FROM st WHERE dst IN {_in(EX + 'Region_4', EX + 'type_SMALL')}")
sql("bgp_path_optional", f"so AS (SELECT s, o FROM g WHERE p = '{v.SUBPROPERTY}' AND s_kind = 'iri' AND o_kind = 'iri') SELECT s AS p, o AS q FROM so UNION SELECT s, s FROM so UNION SELECT o, o FROM so")
sql("bgp_top", f"SELECT o AS part, count(*) AS n FROM g WHERE p = '{EX}contains' GROUP BY o ORDER BY n DESC, part LIMIT 25")
sql("bgp_filter", f"SELECT a.o AS status, count(*) AS n FROM g a JOIN g b ON a.s = b.s AND b.p = '{EX}totalPrice' WHERE a.p = '{EX}status' AND a.o <> 'O' AND TRY_CAST(b.o AS DECIMAL(18,2)) > 300000 GROUP BY a.o")
ORACLE_SQL["bgp_expectations"] = "SELECT * FROM (VALUES ('segments', 'passed'), ('building', 'passed'), ('six', 'failed'), ('any', 'passed'), ('none', 'passed'), ('broken', 'error')) AS t(name, status)"

_lb = f"SELECT a.s AS c, a.o AS segment, b.o AS label FROM g a JOIN g b ON a.s = b.s AND b.p = '{v.LABEL}' WHERE a.p = '{v.SUBCLASS}'"
sql("bgp_bind_values", f"lb AS ({_lb}), vals AS (SELECT * FROM (VALUES ('{EX}Segment_BUILDING', 1), ('{EX}Segment_MACHINERY', 2), ('{EX}Segment_NONE', 3)) AS t(segment, weight)) SELECT segment, upper(substr(label, 1, 3)) AS initial, count(*) AS n, avg(length(label) * weight) AS mean_size, max(label) AS last_label FROM lb JOIN vals USING (segment) GROUP BY ALL HAVING count(*) > 1")
sql("bgp_regex_lang", f"SELECT o_lang, count(DISTINCT s) AS subjects, min(o) AS first_label FROM g WHERE p = '{v.LABEL}' AND o_kind = 'literal' AND regexp_matches(o, '^[A-Z][a-z]+') AND regexp_matches(lower(o_lang), '^(en|de|fr)(-|$)') GROUP BY o_lang")
sql("bgp_order_offset", f"SELECT DISTINCT s AS c, o AS label FROM g WHERE p = '{v.LABEL}' ORDER BY o DESC, s LIMIT 40 OFFSET 10")
NS2 = f"ns2 AS (SELECT DISTINCT a.o AS nation, b.o AS segment FROM g a JOIN g b ON a.s = b.s AND b.p = '{v.SUBCLASS}' AND contains(b.o, '#Segment_') WHERE a.p = '{v.SUBCLASS}' AND contains(a.o, '#Nation_'))"
sql("bgp_group_concat", f"{NS2} SELECT nation, string_agg({local('segment')}, ',' ORDER BY {local('segment')}) AS segments FROM ns2 GROUP BY nation")
sql("bgp_construct", f"{NS2} SELECT nation AS s, '{EX}serves' AS p, segment AS o FROM ns2 UNION SELECT segment, '{v.TYPE}', '{EX}Served' FROM ns2")
sql("bgp_typed_literal", f"SELECT b.o AS property FROM g a JOIN g b ON a.s = b.s AND b.p = '{v.ON_PROPERTY}' WHERE a.p = '{v.MIN_CARD}' AND a.o_dt = '{v.XSD}nonNegativeInteger' AND TRY_CAST(a.o AS BIGINT) >= 3")
sql("bgp_path_sequence", f"SELECT a.o AS s, count(*) AS n, min(b.o) AS first_part FROM g a JOIN g b ON a.s = b.s AND b.p = '{EX}contains' WHERE a.p = '{v.TYPE}' GROUP BY a.o")
sql("bgp_path_alternative", f"SELECT o, count(*) AS n, count(DISTINCT s) AS subjects FROM g WHERE p IN {_in(v.DOMAIN, v.RANGE)} GROUP BY o")
sql("bgp_subselect", f"t AS (SELECT a.o AS customer, count(*) AS n FROM g a JOIN g b ON a.s = b.s AND b.p = '{EX}status' WHERE a.p = '{v.TYPE}' GROUP BY a.o) SELECT customer, n FROM t WHERE n > 2 * (SELECT avg(n) FROM t)")
ORACLE_SQL["cq_totals"] = f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM ({ORACLE_SQL['bgp_expectations']})"

# more descriptions, diagrams, modules
_in_c = "ie AS (SELECT DISTINCT src, dst FROM e WHERE src IN (SELECT uri FROM ci) AND dst IN (SELECT uri FROM ci))"
_top = f"dst IN {_in(*TOPS)}"
sql("describe_hierarchy", f"""{_in_c}, ro AS (SELECT uri FROM ci WHERE uri NOT IN (SELECT src FROM e WHERE NOT {_top})), bd AS ({ORACLE_SQL['bfs_depth']})
SELECT (SELECT count(*) FROM ci) AS classes, (SELECT count(*) FROM ro) AS roots, (SELECT count(*) FROM ro WHERE uri NOT IN (SELECT dst FROM ie)) AS orphans, (SELECT max(depth) FROM bd) AS max_depth, (SELECT count(*) FROM up WHERE src = dst AND src IN (SELECT uri FROM ci)) AS in_cycles""")
ORACLE_SQL["describe_unimported"] = f"SELECT ns, n FROM ({ORACLE_SQL['namespace_categories']}) WHERE category = 'external' AND ns NOT IN {_in(*SPACES)} AND ns <> ''"
sql("class_tree", f"{_in_c}, al AS (SELECT dst AS parent, src AS child FROM ie UNION ALL SELECT '', uri FROM ci WHERE uri NOT IN (SELECT src FROM ie)) SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY {qname('child')}) AS place FROM al")
EVC = f"ev AS (SELECT uri FROM ci), io AS (SELECT s AS uri, o AS class FROM g WHERE p = '{v.TYPE}' AND s_kind = 'iri' AND o IN (SELECT uri FROM ev) AND s NOT IN (SELECT uri FROM c))"
_dot = lambda x: f"replace({qname(x)}, ':', '.')"
sql("uml_instances", f"{EVC} SELECT class, count(*) AS n, min(uri) AS first_uri FROM io GROUP BY class")
sql("uml_type_arrows", f"{EVC} SELECT {_dot('uri')} || ' -u[#FF0000]-> ' || {_dot('class')} || ' : <<rdf:type>>' AS line FROM io")
_note = "'N_' || substr(sha256(s || '|' || p || '|' || o), 1, 12)"
sql("uml_notes", f"{EVC} SELECT 'note \"' || replace(o, '\"', chr(39)) || '\" as ' || {_note} || ' / ' || {_dot('s')} || ' .u. ' || {_note} || ' : <<' || {qname('p')} || '>>' AS line FROM g WHERE o_kind = 'literal' AND p IN (SELECT s FROM g WHERE p = '{v.TYPE}' AND o = '{v.DATATYPE_PROPERTY}') AND s IN (SELECT uri FROM io)")
sql("uml_styles", f"""gv AS (SELECT * FROM (VALUES ('{EX}Region_1', 'blue'), ('{EX}Nation_3', 'red'), ('{EX}Entity', 'grey'), ('{EX}Segment_BUILDING', 'brown')) AS t(dst, style)),
dd AS (SELECT src, dst, 1 AS k FROM e UNION SELECT dd.src, e.dst, k + 1 FROM dd JOIN e ON dd.dst = e.src WHERE k < 12), dm AS (SELECT src, dst, min(k) AS k FROM dd WHERE src <> dst GROUP BY src, dst),
ab AS (SELECT src AS uri, style FROM dm JOIN gv USING (dst) QUALIFY row_number() OVER (PARTITION BY src ORDER BY k, dst) = 1)
SELECT ci.uri, coalesce(gv.style, ab.style, CASE WHEN starts_with(ci.uri, '{EX}type_') THEN 'green' END, 'white') AS style, CASE WHEN gv.style IS NOT NULL THEN 'own' WHEN ab.style IS NOT NULL THEN 'inherited' WHEN starts_with(ci.uri, '{EX}type_') THEN 'namespace' ELSE 'default' END AS how
FROM ci LEFT JOIN gv ON gv.dst = ci.uri LEFT JOIN ab ON ab.uri = ci.uri""")
ORACLE_SQL["split_imports"] = f"WITH d AS ({ORACLE_SQL['split_dependencies']}) SELECT 'http://example.org/' || module AS s, '{v.TYPE}' AS p, '{v.ONTOLOGY}' AS o FROM d UNION SELECT 'http://example.org/' || module, '{v.IMPORTS}', needs || '.ttl' FROM d UNION SELECT 'http://example.org/nations', '{v.IMPORTS}', 'http://example.org/upper.ttl' FROM d WHERE module = 'nations'"
ORACLE_SQL["split_totals"] = f"SELECT count(*) AS modules, CAST(sum(classes) AS BIGINT) AS classes, CAST(sum(properties) AS BIGINT) AS properties, CAST(sum(triples) AS BIGINT) AS triples FROM ({ORACLE_SQL['split_module_stats']})"
_re = lambda x, w: f"CASE WHEN {w} AND starts_with({x}, '{EX}') THEN 'http://example.org/v2#' || substr({x}, {len(EX) + 1}) ELSE {x} END"
_iri_s, _iri_o = "s_kind = 'iri'", "o_kind = 'iri'"
sql("merge_remapped", f"rm AS (SELECT s, s_kind, p, o, o_kind, o_dt, o_lang FROM g UNION SELECT {_re('s', _iri_s)}, s_kind, {_re('p', 'true')}, {_re('o', _iri_o)}, o_kind, o_dt, o_lang FROM h) SELECT {ns('s')} AS ns, count(*) AS n, count(DISTINCT p) AS predicates FROM rm GROUP BY 1", True)
sql("scan_nquads", f"SELECT CASE WHEN o_kind = 'iri' THEN {ns('o')} ELSE '' END AS g, count(*) AS n, CAST(0 AS BIGINT) AS errors, count(DISTINCT p) AS predicates FROM g GROUP BY 1")

# class models
_ty = lambda t: f"SELECT s FROM g WHERE p = '{v.TYPE}' AND s_kind = 'iri' AND o = '{t}'"
_out = lambda p: f"SELECT s || ' -> ' || o AS entity FROM g WHERE p = '{p}' AND o_kind = 'iri' AND s IN ({_ty(v.OBJECT_PROPERTY)}) AND o NOT IN (SELECT uri FROM c)"
_said = lambda p: f"(SELECT s FROM g WHERE p = '{p}')"
sql("validate_graph", f"""al AS (SELECT 'UNTYPED_CLASS' AS code, 'warning' AS severity, s AS entity FROM g WHERE p = '{v.SUBCLASS}' AND s_kind = 'iri' AND s NOT IN (SELECT uri FROM c)
UNION ALL SELECT 'MISSING_DOMAIN', 'info', s FROM ({_ty(v.OBJECT_PROPERTY)}) WHERE s NOT IN {_said(v.DOMAIN)}
UNION ALL SELECT 'MISSING_RANGE', 'info', s FROM ({_ty(v.OBJECT_PROPERTY)} UNION ALL {_ty(v.DATATYPE_PROPERTY)}) WHERE s NOT IN {_said(v.RANGE)}
UNION ALL SELECT 'UNDEFINED_DOMAIN', 'warning', entity FROM ({_out(v.DOMAIN)}) UNION ALL SELECT 'EXTERNAL_RANGE', 'info', entity FROM ({_out(v.RANGE)}))
SELECT code, severity, entity, count(*) AS n FROM al GROUP BY ALL""")

MODEL = """WITH RECURSIVE mc AS (SELECT lower(c_mktsegment) AS package, 'BigCustomer' || c_custkey AS name, CASE WHEN c_custkey % 5 = 0 THEN c_name END AS display, CASE WHEN c_acctbal < 0 THEN 'owes in ' || c_mktsegment END AS note FROM customer
UNION ALL SELECT NULL, 'Nation' || n_nationkey, n_name, NULL FROM nation UNION ALL SELECT 'supply', 'BigCustomer' || s_suppkey, NULL, NULL FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT 'supply', 'XMLSource' || s_suppkey, NULL, NULL FROM supplier),
ma AS (SELECT lower(c_mktsegment) AS package, 'BigCustomer' || o_custkey AS class, 'orderTotalOf' || o_orderkey AS name, CASE WHEN o_orderkey % 11 > 0 THEN ['decimal', 'Int', 'xsd:date', 'money', 'text'][CAST(o_orderkey % 5 + 1 AS INT)] END AS datatype FROM orders JOIN customer ON o_custkey = c_custkey ),
mr AS (SELECT lower(c_mktsegment) || '.BigCustomer' || c_custkey AS source, 'Nation' || c_nationkey AS target, 'inheritance' AS kind, CAST(NULL AS VARCHAR) AS label FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'Nation' || n_nationkey, 'Nation' || ((n_nationkey + 1) % 3), 'inheritance', NULL FROM nation WHERE n_nationkey < 3
UNION ALL SELECT 'Nation' || s_nationkey, CASE WHEN s_suppkey % 20 = 7 THEN 'Ghost' ELSE 'XMLSource' END || s_suppkey, 'association', CASE s_suppkey % 3 WHEN 1 THEN 'supplies goods To' WHEN 2 THEN 'hasSource-' || s_suppkey END FROM supplier),
mq AS (SELECT *, CASE WHEN package IS NULL THEN name ELSE package || '.' || name END AS full_name FROM mc),
"""
MODEL_ISSUES = MODEL + f"""kn AS (SELECT name FROM mq UNION SELECT full_name FROM mq), en AS (SELECT source AS e FROM mr UNION ALL SELECT target FROM mr),
ic AS (SELECT source AS a, target AS b FROM mr WHERE kind = 'inheritance' UNION SELECT ic.a, mr.target FROM ic JOIN mr ON ic.b = mr.source AND mr.kind = 'inheritance'),
ii AS (SELECT 'DUPLICATE_CLASS' AS code, 'error' AS severity, name AS entity, count(*) - 1 AS n FROM mc GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'UNKNOWN_CLASS', 'error', e, count(*) FROM en WHERE e NOT IN (SELECT name FROM kn) GROUP BY e UNION ALL SELECT 'INHERITANCE_CYCLE', 'error', a, 1 FROM ic WHERE a = b
UNION ALL SELECT 'UNKNOWN_DATATYPE', 'warning', class || '.' || name, count(*) FROM ma WHERE lower(datatype) NOT IN {_in(*DATATYPES)} AND NOT starts_with(datatype, 'xsd:') GROUP BY 3
UNION ALL SELECT 'ISOLATED_CLASS', 'info', name, count(*) FROM mc WHERE name NOT IN (SELECT e FROM en) AND NOT EXISTS (SELECT 1 FROM ma WHERE ma.class = mc.name AND ma.package IS NOT DISTINCT FROM mc.package) GROUP BY name) """
ORACLE_SQL["model_issues"] = MODEL_ISSUES + "SELECT code, severity, entity, n FROM ii"
ORACLE_SQL["model_issue_counts"] = MODEL_ISSUES + "SELECT code, severity, count(*) AS entities, CAST(sum(n) AS BIGINT) AS n FROM ii GROUP BY ALL"


def model_sql(base: str) -> str:
    """Tables on the WITH list up to ``mg``, the triples of the model."""
    bare = base.rstrip("#/")
    space = lambda p: f"CASE WHEN {p} IS NULL THEN '{base}' ELSE '{bare}/' || {p} || '#' END"
    words = lambda x: f"lower(regexp_replace({x}, '([a-z])([A-Z])|([A-Z])([A-Z][a-z])', '\\1\\3 \\2\\4', 'g'))"
    kinds = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in DATATYPES.items())
    row = lambda s, p, o, src, lit="": f"SELECT {s} AS s, 'iri' AS s_kind, '{p}' AS p, {o} AS o, '{'literal' if lit else 'iri'}' AS o_kind, '' AS o_dt, '{lit}' AS o_lang FROM {src}"
    rows = [
        row(f"'{bare}'", v.TYPE, f"'{v.ONTOLOGY}'", "(SELECT 1)"), row(f"'{bare}'", v.LABEL, "'Model'", "(SELECT 1)", "en"), row("uri", v.TYPE, f"'{v.OWL_CLASS}'", "mu"), row("uri", v.LABEL, f"coalesce(display, {words('name')})", "mu", "en"),
        row("uri", v.COMMENT, "note", "mu WHERE note IS NOT NULL", "en"), row("uri", v.TYPE, f"'{v.DATATYPE_PROPERTY}'", "mt"), row("uri", v.DOMAIN, "owner", "mt"), row("uri", v.LABEL, words("name"), "mt", "en"),
        row("uri", v.RANGE, f"'{v.XSD}' || CASE lower(trim(datatype)) {kinds} ELSE CASE WHEN starts_with(datatype, 'xsd:') THEN substr(datatype, 5) ELSE 'string' END END", "mt WHERE datatype IS NOT NULL"),
        row("source_uri", v.SUBCLASS, "target_uri", "ml WHERE kind = 'inheritance'"), row("path", v.TYPE, f"'{v.OBJECT_PROPERTY}'", "mp"), row("path", v.DOMAIN, "source_uri", "mp"), row("path", v.RANGE, "target_uri", "mp"),
        row("path", v.LABEL, f"coalesce(label, {words('own')})", "mp", "en"),
    ]
    return f"""mu AS (SELECT *, {space('package')} AS sp, {space('package')} || name AS uri FROM mq), mt AS (SELECT *, {space('package')} || name AS uri, {space('package')} || class AS owner FROM ma),
nk AS (SELECT k, min(uri) AS uri, min_by(sp, uri) AS sp FROM (SELECT name AS k, uri, sp FROM mu UNION ALL SELECT full_name, uri, sp FROM mu) GROUP BY k),
ml AS (SELECT mr.*, a.uri AS source_uri, a.sp AS source_sp, b.uri AS target_uri FROM mr JOIN nk a ON a.k = source JOIN nk b ON b.k = target),
mo AS (SELECT *, CASE WHEN label IS NULL THEN 'has' || target WHEN contains(label, ' ') THEN regexp_replace(lower(string_split(label, ' ')[1]) || array_to_string(list_transform(string_split(label, ' ')[2:], lambda w: upper(w[1]) || lower(w[2:])), ''), '[^a-zA-Z0-9]', '', 'g') ELSE regexp_replace(label, '[^a-zA-Z0-9]', '', 'g') END AS own FROM ml WHERE kind <> 'inheritance'),
mp AS (SELECT *, source_sp || own AS path FROM mo), mg AS ({' UNION '.join(rows)})"""


ORACLE_SQL["model_to_graph"] = MODEL + model_sql("http://example.org/model#") + " SELECT s, p, o, o_lang FROM mg"
_existing = f"SELECT s, s_kind, p, o, o_kind, o_dt, o_lang FROM g UNION SELECT * FROM mg WHERE NOT (p = '{v.LABEL}' AND s IN (SELECT s FROM g WHERE p = '{v.LABEL}'))"
ORACLE_SQL["model_merged"] = MODEL + G + model_sql(EX) + f" SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM ({_existing}) GROUP BY p"


# selections of diagrams, names, orders, manifests
_walk2 = walk_sql(f"SELECT '{EX}Region_1' AS uri, 0 AS depth", 1)
sql("uml_select_roots", f"{_walk2} SELECT DISTINCT uri FROM w")
_pk = f"pk AS (SELECT DISTINCT s AS uri, CASE o WHEN '{v.OBJECT_PROPERTY}' THEN 'object' WHEN '{v.DATATYPE_PROPERTY}' THEN 'datatype' ELSE 'annotation' END AS kind FROM g WHERE p = '{v.TYPE}' AND o IN {_in(v.OBJECT_PROPERTY, v.DATATYPE_PROPERTY, v.ANNOTATION_PROPERTY)})"
_dom, _rng = f"uri IN (SELECT s FROM g WHERE p = '{v.DOMAIN}' AND o IN (SELECT uri FROM w))", f"uri IN (SELECT s FROM g WHERE p = '{v.RANGE}' AND o IN (SELECT uri FROM ci))"
_rng = _rng.replace("FROM ci", "FROM w")
sql("uml_select_properties", f"""{walk_sql(f"SELECT '{EX}Entity' AS uri, 0 AS depth UNION ALL SELECT '{EX}type_PROMO', 0")}, {_pk}, al AS (SELECT 'all' AS mode, * FROM pk UNION ALL SELECT 'explicit', * FROM pk WHERE uri IN {_in(EX + 'status', EX + 'note')} UNION ALL SELECT 'domain_based', * FROM pk WHERE {_dom}
UNION ALL SELECT 'connected', * FROM pk WHERE {_dom} AND (kind = 'datatype' OR kind = 'object' AND {_rng})) SELECT mode, kind, count(*) AS n, min(uri) AS first_uri FROM al WHERE uri <> '{EX}totalPrice' GROUP BY ALL""")
ORACLE_SQL["uml_select_explicit"] = f"SELECT * FROM (VALUES ('{EX}Entity', 'class'), ('{EX}status', 'datatype'), ('{EX}contains', 'object'), ('{EX}note', 'annotation'), ('{EX}Nowhere', 'unknown'), ('{EX}Ontology', 'instance')) AS t(uri, kind)"
_q = lambda x: qname(x)
sql("uml_instance_links", f"{EVC} SELECT {_dot('s')} || ' --> ' || {_dot('o')} || ' : ' || {qname('p')} AS line FROM g WHERE o_kind = 'iri' AND p IN (SELECT s FROM g WHERE p = '{v.TYPE}' AND o = '{v.OBJECT_PROPERTY}') AND s IN (SELECT uri FROM io) AND o IN (SELECT uri FROM io)")
_words = "regexp_split_to_array(x, '[ \t\n\x0b\f\r]+')"
sql("uml_labels", f"l AS (SELECT s, min(o) AS x FROM g WHERE p = '{v.LABEL}' AND o_kind = 'literal' GROUP BY s), sb AS (SELECT DISTINCT s AS uri FROM g WHERE s_kind = 'iri') SELECT uri, coalesce({_words}[1] || array_to_string(list_transform({_words}[2:], lambda w: replace(replace(upper(w[1]), 'ß', 'SS'), 'ẞ', 'SS') || w[2:]), ''), {qname('uri')}) AS shown FROM sb LEFT JOIN l ON l.s = sb.uri")
sql("uml_stereotypes", f"{EVC}, ty AS (SELECT uri, list_sort(list(DISTINCT {qname('class')})) AS t FROM io GROUP BY uri) SELECT uri, '<<' || array_to_string(t[1:3], ', ') || '>>' AS stereotype FROM ty")
_names = " ".join(f"WHEN '{p}' THEN '{n}'" for n, p in (("isDefinedBy", v.RDFS + "isDefinedBy"), ("note", v.SKOS + "note"), ("creator", v.DCTERMS + "creator"), ("seeAlso", v.RDFS + "seeAlso")))
sql("docs_annotations", f"SELECT s AS uri, CASE p {_names} END AS name, string_agg(o, ' | ' ORDER BY o) AS values FROM g WHERE p IN {_in(v.RDFS + 'isDefinedBy', v.SKOS + 'note', v.DCTERMS + 'creator', v.RDFS + 'seeAlso')} GROUP BY ALL")
_file = lambda d: f"'{d}/' || translate(substr({qname('uri')}, instr({qname('uri')}, ':') + 1), '/\\#', '___') || '.md'"
_kinds = [("class", "classes", "SELECT uri FROM ci")] + [(k, d, f"SELECT DISTINCT s AS uri FROM g WHERE p = '{v.TYPE}' AND s_kind = 'iri' AND o = '{t}'") for k, d, t in (("object_property", "properties/object", v.OBJECT_PROPERTY), ("datatype_property", "properties/datatype", v.DATATYPE_PROPERTY), ("annotation_property", "properties/annotation", v.ANNOTATION_PROPERTY))] + [("instance", "instances", ORACLE_SQL["sel_named_individuals"][ORACLE_SQL["sel_named_individuals"].rindex("SELECT DISTINCT s AS uri") :])]
sql("docs_files", "x AS (SELECT 1) " + " UNION ALL ".join(f"SELECT uri, '{k}' AS kind, {_file(d)} AS path FROM ({q})" for k, d, q in _kinds))
sql("names_expanded", f"r AS ({NODE3}), q2 AS (SELECT uri, {qname('uri')} AS q FROM r) SELECT CASE WHEN starts_with(q, '<') THEN '<>' ELSE split_part(q, ':', 1) END AS prefix, count(*) AS n, count(*) AS n_back FROM q2 GROUP BY 1")
_sp = [("rdfs:", v.RDFS), ("skos:", v.SKOS), ("owl:", v.OWL), ("rdf:", v.RDF), ("dc:", "http://purl.org/dc/elements/1.1/"), ("dcterms:", v.DCTERMS)]
sql("property_prefixes", "SELECT DISTINCT p, CASE " + " ".join(f"WHEN starts_with(p, '{n}') THEN '{x}' || substr(p, {len(n) + 1})" for x, n in _sp) + " ELSE p END AS short, p AS back FROM g")
_cv = "SELECT DISTINCT m.s, m.p, ord, priority, CASE ord WHEN 0 THEN 'core' ELSE 'extension' END AS source, o FROM m JOIN cf USING (s, p) WHERE s_kind = 'iri'"
sql("merge_markers", f"{conflict_sql('true')}, cv AS ({_cv}), cm AS (SELECT s, p, string_agg('# Source: ' || source || ' (priority ' || priority || '): ' || o, chr(10) ORDER BY ord, o) AS told FROM cv GROUP BY s, p) SELECT s, p, '# === CONFLICT: ' || {qname('s')} || ' ' || {qname('p')} || ' ===' || chr(10) || told || chr(10) || '# Resolution: UNRESOLVED - values differ, manual review required' || chr(10) || '# === END CONFLICT ===' AS marker FROM cm", True)
sql("order_alphabetical", f"SELECT uri, row_number() OVER (ORDER BY {qname('uri')}) AS place FROM ci")
_br = " UNION ALL ".join(f"SELECT uri, {k} AS branch FROM w{k}" for k in (0, 1))
sql("order_root_branches", f"""{CE} ie3 AS (SELECT src, dst FROM e WHERE src IN (SELECT uri FROM ci) AND dst IN (SELECT uri FROM ci)), {walk_sql(f"SELECT '{EX}Region_2' AS uri, 0 AS depth", edges='ie3').replace('w AS', 'w0 AS').replace('FROM w JOIN', 'FROM w0 w JOIN')}, {walk_sql(f"SELECT '{EX}Segment_BUILDING' AS uri, 0 AS depth", edges='ie3').replace('w AS', 'w1 AS').replace('FROM w JOIN', 'FROM w1 w JOIN')},
br AS (SELECT uri, min(branch) AS branch FROM ({_br}) GROUP BY uri), lb AS (SELECT ld.uri, coalesce(branch, 2) AS branch, depth AS level FROM ld LEFT JOIN br USING (uri) WHERE ld.uri IN (SELECT uri FROM ci))
SELECT uri, branch, CAST(level AS BIGINT) AS level, row_number() OVER (PARTITION BY branch ORDER BY level, {qname('uri')}) AS place FROM lb""")
ORACLE_SQL["split_manifest"] = f"WITH ms AS ({ORACLE_SQL['split_module_stats']}), dp AS ({ORACLE_SQL['split_dependencies']}), dd AS (SELECT module, string_agg(DISTINCT needs, ' ' ORDER BY needs) AS d FROM dp GROUP BY module) SELECT module, module || '.ttl' AS file, classes, properties, triples, CASE module WHEN 'nations' THEN 'http://example.org/upper.ttl' ELSE '' END AS imports, coalesce(d, '') AS dependencies FROM ms LEFT JOIN dd USING (module)"
sql("bgp_describe", f"bw AS (SELECT '{EX}Nation_3' AS s UNION SELECT '{EX}Segment_BUILDING' UNION SELECT g.o FROM bw JOIN g ON g.s = bw.s AND g.o_kind = 'bnode') SELECT s, p, o FROM g WHERE s IN (SELECT s FROM bw)")
ORACLE_SQL["cq_skipped"] = "SELECT * FROM (VALUES ('segments', 'skipped'), ('six', 'failed')) AS t(name, status)"
sql("sel_named_like", "SELECT uri FROM ci WHERE (contains(uri, 'Nation_1') OR contains(uri, 'Region')) AND NOT contains(uri, '_13')")


# reports
_ln = "p || ' ' || o"
sql("diff_changes", f"{DIFF} SELECT s AS uri, coalesce(string_agg({_ln}, chr(10) ORDER BY {_ln}) FILTER (WHERE change = 'added'), '') AS added, coalesce(string_agg({_ln}, chr(10) ORDER BY {_ln}) FILTER (WHERE change = 'removed'), '') AS removed FROM dt WHERE s_kind = 'iri' AND p <> '{v.COMMENT}' GROUP BY s", True)
sql("diff_listed", f"{ENT} SELECT uri, label, row_number() OVER (ORDER BY coalesce(label, uri), uri) AS place FROM de", True)
_pos = lambda t, n: f"SELECT '{n}' AS source, 'subject' AS position, s AS x FROM {t} WHERE s_kind = 'iri' UNION ALL SELECT '{n}', 'predicate', p FROM {t} UNION ALL SELECT '{n}', 'object', o FROM {t} WHERE o_kind = 'iri'"
sql("rename_stats_by_source", f"{MP} r AS ({_pos('g', 'core')} UNION ALL {_pos('h', 'extension')}) SELECT source, position, count(*) AS n FROM r WHERE x IN (SELECT old FROM mp) GROUP BY ALL", True)
sql("migrate_counts", f"SELECT count(*) AS matched, CAST(2 * count(*) FILTER (WHERE contains(o, ' of ')) AS BIGINT) AS made FROM g WHERE p = '{v.COMMENT}'")
sql("localise_merge_counts", f"""{LOC}, sc AS (SELECT uri, property, o, EXISTS (SELECT 1 FROM g WHERE g.s = tx.uri AND g.p = tx.property AND g.o_kind = 'literal' AND g.o_lang = 'de') AS there FROM tx WHERE lang = 'en')
SELECT CASE WHEN length(o) % 5 = 0 THEN 'empty' WHEN length(o) % 2 = 1 THEN 'status' WHEN there THEN 'existing' ELSE 'added' END AS outcome, count(*) AS n FROM sc GROUP BY 1""")
_pc = f"SELECT kind, count(*) AS n FROM ({ORACLE_SQL['docs_files'][ORACLE_SQL['docs_files'].index('x AS (SELECT 1) ') + 16 :]}) WHERE kind <> 'instance' GROUP BY kind"
sql("docs_page_counts", f"pc AS ({_pc}) SELECT * FROM pc UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM pc")
_two = walk_sql(f"SELECT '{EX}Region_1' AS uri, 0 AS depth UNION ALL SELECT '{EX}Region_3', 0")
sql("uml_property_arrows", f"{_two}, pr AS (SELECT DISTINCT s AS uri FROM g WHERE p = '{v.DOMAIN}' AND o IN (SELECT uri FROM w) AND s IN (SELECT uri FROM q)) SELECT {local('s')} || ' --|> ' || {local('o')} AS line FROM g WHERE p = '{v.SUBPROPERTY}' AND s IN (SELECT uri FROM pr) AND o IN (SELECT uri FROM pr)")
sql("split_property_descendants", f"""{walk_sql(f"SELECT '{EX}Region_1' AS uri, 0 AS depth")}, pw AS (SELECT '{EX}supplies_1' AS uri UNION SELECT g.s FROM pw JOIN g ON g.p = '{v.SUBPROPERTY}' AND g.o = pw.uri),
kn AS (SELECT uri, 'class' AS kind FROM ci UNION ALL SELECT uri, 'property' FROM q WHERE uri NOT IN (SELECT uri FROM ci)) SELECT uri, CASE WHEN uri IN (SELECT uri FROM pw) THEN 'first' WHEN uri IN (SELECT uri FROM w) THEN 'nations' ELSE 'common' END AS module, kind FROM kn""")
sql("order_sections_header", f"a AS (SELECT s AS uri, 0 AS k, 'header' AS section FROM g WHERE p = '{v.TYPE}' AND o = '{v.ONTOLOGY}' UNION ALL SELECT uri, 1, 'classes' FROM c UNION ALL SELECT s, 2, 'obj_props' FROM g WHERE p = '{v.TYPE}' AND o = '{v.OBJECT_PROPERTY}' UNION ALL SELECT s, 3, 'individuals' FROM g WHERE s NOT IN (SELECT uri FROM c) AND s NOT IN (SELECT uri FROM q)), b AS (SELECT uri, min_by(section, k) AS section FROM a GROUP BY uri) SELECT section, count(*) AS n, min(uri) AS first_uri FROM b GROUP BY section")

# cheap forms, from the tables themselves
ORACLE_SQL["bgp_join"] = f"""SELECT '{EX}order_' || o_orderkey AS "order", '{EX}Customer_' || c_custkey AS customer, '{EX}Nation_' || n_nationkey AS nation
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2"""
ORACLE_SQL["bgp_minus"] = f"""SELECT '{EX}Entity' AS c UNION ALL SELECT '{EX}Customer_' || c_custkey FROM customer WHERE (c_acctbal >= 0) IS NOT TRUE OR c_name IS NULL
UNION ALL SELECT DISTINCT '{EX}type_' || p_type FROM part UNION ALL SELECT DISTINCT '{EX}EventType_' || event_type FROM events"""
ORACLE_SQL["lint_empty_ontology"] = f"""WITH f(s, s_kind, p, o, o_kind, o_dt, o_lang) AS (VALUES {_fixed()})
SELECT 'empty-ontology' AS rule_id, 'error' AS severity, s AS entity, '' AS detail FROM f WHERE p = '{v.TYPE}' AND o = '{v.ONTOLOGY}' AND s_kind = 'iri'
AND NOT EXISTS (SELECT 1 FROM f AS h WHERE h.s = f.s AND h.p IN {_in(*HEADER_NOTES)})"""

# cycles, nested nodes, names, rules and lines
_LISTS = """li AS MATERIALIZED (SELECT DISTINCT l_orderkey AS k, l_partkey AS a FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P'))"""
_TYPES = ["ECONOMY", "LARGE", "MEDIUM"]
# every list is a circle, so its items are one component, and lists that share an item are too
ORACLE_SQL["cycle_components"] = f"""WITH RECURSIVE {_LISTS}, nd AS (SELECT DISTINCT a FROM li), hub AS (SELECT k, min(a) AS m FROM li GROUP BY k),
ed AS MATERIALIZED (SELECT DISTINCT m AS x, a AS y FROM li JOIN hub USING (k) WHERE m <> a UNION SELECT a, m FROM li JOIN hub USING (k) WHERE m <> a),
cc(a, c) USING KEY (a) AS (SELECT a, '{EX}part_' || a FROM nd UNION SELECT ed.y, min(cc.c) FROM cc JOIN ed ON ed.x = cc.a JOIN recurring.cc AS o ON o.a = ed.y WHERE cc.c < o.c GROUP BY ed.y)
SELECT '{EX}part_' || a AS uri, c AS component FROM cc UNION ALL SELECT '{EX}type_' || t, '{EX}type_ECONOMY' FROM (VALUES {', '.join(f"('{t}')" for t in _TYPES)}) AS t(t)
UNION ALL SELECT x, 'F' FROM (VALUES ('F'), ('O'), ('P')) AS t(x)"""
ORACLE_SQL["cycle_paths"] = f"""WITH {_LISTS}, pl AS (SELECT k, 'part_' || k || '_' || a AS cell, row_number() OVER (PARTITION BY k ORDER BY a) AS i, count(*) OVER (PARTITION BY k) AS n FROM li),
lo AS (SELECT k, min(cell) AS least, arg_min(i, cell) AS i0 FROM pl GROUP BY k)
SELECT least AS component, (i - i0 + n) % n AS position, cell AS uri FROM pl JOIN lo USING (k)
UNION ALL SELECT 'l0', i, 'l' || i FROM range(3) AS t(i) UNION ALL SELECT '{EX}type_ECONOMY', i - 1, '{EX}type_' || ['ECONOMY', 'LARGE', 'MEDIUM'][i] FROM range(1, 4) AS t(i)"""
_ring = f"CASE WHEN {{x}} IN {_in(*(EX + 'type_' + t for t in _TYPES))} THEN '{EX}type_ECONOMY' ELSE {{x}} END"
sql("cycle_condensed", f"ce AS (SELECT DISTINCT {_ring.format(x='src')} AS src, {_ring.format(x='dst')} AS dst FROM e) SELECT dst, count(*) AS n, min(src) AS first_src FROM ce WHERE src <> dst GROUP BY dst")

_deep = "replace({x}, chr(10), chr(10) || '    ')"
_body = "string_agg(line, ' ;' || chr(10) || '    ' ORDER BY place, pp)"
# restrictions nest nothing; a list's text is put together cell by cell: the openings of all cells, the end, then what closes them
sql("turtle_nested", f"""bl AS (SELECT s, {_pp} AS pp, {_place} AS place, {_pp} || ' ' || string_agg(DISTINCT {_fmt}, ', ' ORDER BY {_fmt}) AS line FROM g WHERE s_kind = 'bnode' AND p NOT IN ('{v.FIRST}', '{v.REST}')
  AND EXISTS (SELECT 1 FROM g AS r WHERE r.s = g.s AND r.p = '{v.ON_PROPERTY}') GROUP BY s, p),
lc AS (SELECT h.s AS owner, h.o AS head, fi.o AS x, fi.o_kind AS kind, row_number() OVER (PARTITION BY h.s ORDER BY TRY_CAST(split_part(fi.s, '_', 3) AS BIGINT), fi.s) AS i, count(*) OVER (PARTITION BY h.s) AS n
  FROM g AS h JOIN g AS fi ON fi.p = '{v.FIRST}' AND CASE WHEN fi.s LIKE 'part_%' THEN h.s = '{EX}parts_of_' || split_part(fi.s, '_', 2) ELSE h.s = '{EX}StatusEnum' END WHERE h.p = '{v.ONE_OF}'),
bt AS MATERIALIZED (SELECT s, '[' || chr(10) || '    ' || {_body} || chr(10) || ']' AS t FROM bl GROUP BY s
  UNION ALL SELECT head, string_agg('[' || chr(10) || repeat('    ', i) || 'rdf:first ' || CASE kind WHEN 'iri' THEN 'ex:' || substr(x, {len(EX) + 1}) ELSE '"' || x || '"' END || ' ;' || chr(10) || repeat('    ', i) || 'rdf:rest ', '' ORDER BY i)
  || 'rdf:nil' || string_agg(chr(10) || repeat('    ', i - 1) || ']', '' ORDER BY i DESC) FROM lc GROUP BY head),
ow AS (SELECT s, count(*) AS nested FROM g JOIN (SELECT s AS b FROM bt) ON o = b AND o_kind = 'bnode' WHERE s_kind = 'iri' GROUP BY s),
ol AS (SELECT s, pp, place, pp || ' ' || string_agg(shown, ', ' ORDER BY label) AS line FROM (SELECT DISTINCT s, {_pp} AS pp, {_place} AS place, {_fmt} AS label, coalesce({_deep.format(x='t')}, {_fmt}) AS shown
  FROM g LEFT JOIN (SELECT s AS b, t FROM bt) ON o = b AND o_kind = 'bnode' WHERE EXISTS (SELECT 1 FROM ow WHERE ow.s = g.s)) GROUP BY s, pp, place)
SELECT {qname('ol.s')} AS subject, any_value(nested) AS nested, {qname('ol.s')} || ' ' || {_body} || ' .' AS block
FROM ol JOIN ow ON ow.s = ol.s GROUP BY ol.s""")
sql("mentions_many", """na AS (SELECT s_name AS name FROM supplier UNION SELECT n_name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer UNION SELECT p_brand FROM part UNION SELECT p_type FROM part),
tx AS (SELECT o, count(*) AS k FROM g WHERE o_kind = 'literal' GROUP BY o) SELECT name, CAST(sum(k) AS BIGINT) AS n FROM na JOIN tx ON contains(o, name) GROUP BY name""")
_SPACES = f"""sp AS MATERIALIZED (SELECT '{EX}Customer_' || c_custkey AS ns, 'customer_' || c_custkey AS pre, -c_custkey AS place FROM customer UNION ALL SELECT '{EX}Nation_' || n_nationkey, 'nation_' || n_nationkey, n_nationkey FROM nation)"""
sql("namespaces_longest", f"""{_SPACES}, mt AS (SELECT uri, arg_max(pre, length(ns)) AS pre, max(length(ns)) AS n FROM ci JOIN sp ON starts_with(uri, ns) GROUP BY uri)
SELECT ci.uri AS iri, coalesce(pre || ':' || substr(ci.uri, n + 1), '<' || ci.uri || '>') AS qname FROM ci LEFT JOIN mt ON mt.uri = ci.uri""")
sql("namespaces_first", f"""{_SPACES}, ir AS (SELECT src AS x FROM e UNION SELECT dst FROM e), mt AS (SELECT x, arg_min('http://example.org/v2#' || pre || '/' || substr(x, length(ns) + 1), (place, ns)) AS y FROM ir JOIN sp ON starts_with(x, ns) GROUP BY x)
SELECT DISTINCT coalesce(a.y, s) AS s, coalesce(b.y, o) AS o FROM g LEFT JOIN mt AS a ON a.x = s AND s_kind = 'iri' LEFT JOIN mt AS b ON b.x = o AND o_kind = 'iri' WHERE p = '{v.SUBCLASS}'""")
_RULES = f"""pe AS (SELECT '{EX}order_' || o_orderkey AS o, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price, o_orderstatus = 'P' AS pending, '{EX}Customer_' || o_custkey AS c, '{EX}Nation_' || c_nationkey AS n, CASE WHEN c_acctbal >= 0 THEN c_name END AS label
FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""
ORACLE_SQL["rules_applied"] = f"""WITH {_RULES} SELECT o AS s, CASE WHEN pending THEN '{EX}pendingPrice' ELSE '{EX}totalPrice' END AS p, price AS o, 'literal' AS o_kind, '{v.XSD}decimal' AS o_dt FROM pe
UNION ALL SELECT DISTINCT o, '{EX}owedIn', n, 'iri', '' FROM pe WHERE pending AND n IS NOT NULL
UNION ALL SELECT DISTINCT n, '{EX}owedBy', c, 'iri', '' FROM pe WHERE pending AND n IS NOT NULL AND label IS NULL
UNION ALL SELECT DISTINCT c, '{EX}debtor', upper(label || ' of ' || regexp_extract(n, '[^#]*$')), 'literal', '' FROM pe WHERE pending AND n IS NOT NULL AND label IS NOT NULL"""
ORACLE_SQL["rules_counts"] = f"""WITH {_RULES}, m AS (SELECT * FROM pe WHERE pending AND n IS NOT NULL), d AS (SELECT DISTINCT c, n, label FROM m)
SELECT 'pending' AS rule, count(*) AS matched, count(*) AS removed, count(*) AS made FROM pe WHERE pending
UNION ALL SELECT 'owing', count(*), 0, count(DISTINCT (n, c)) + count(DISTINCT (o, n)) FROM m UNION ALL SELECT 'debtors', count(*), count(*), count(*) FROM d WHERE label IS NOT NULL"""
_mv = lambda x, w: f"CASE WHEN NOT ({w}) THEN {x} WHEN {x} = '{EX}type_SMALL' THEN 'http://example.org/v2#kind-LITTLE' WHEN starts_with({x}, '{EX}type_') THEN 'http://example.org/v2#kind-' || substr({x}, {len(EX) + 6}) WHEN starts_with({x}, '{EX}') THEN 'http://example.org/v2#' || substr({x}, {len(EX) + 1}) ELSE {x} END"
sql("migrate_sources", f"""al AS (SELECT DISTINCT 'old' AS source, * FROM g UNION ALL SELECT DISTINCT 'new', * FROM h),
mg AS (SELECT source, {_mv('s', _iri_s)} AS s, s_kind, {_mv('p', 'true')} AS p, {_mv('o', _iri_o)} AS o, o_kind, o_dt, o_lang FROM al),
rl AS (SELECT source, s, p, o FROM mg WHERE p <> '{v.SKOS}note' UNION ALL SELECT DISTINCT 'rules', s, 'http://example.org/v2#balance', o FROM mg WHERE p = '{v.SKOS}note')
SELECT source, p, count(*) AS n, min(s) AS first_s, max(o) AS last_o FROM rl GROUP BY source, p""", True)
_subject = "CASE s_kind WHEN 'bnode' THEN '_:' || s ELSE '<' || s || '>' END"
_object = f"CASE o_kind WHEN 'iri' THEN '<' || o || '>' WHEN 'bnode' THEN '_:' || o ELSE '\"' || {_esc} || '\"' || CASE WHEN o_lang <> '' THEN '@' || o_lang WHEN o_dt <> '' THEN '^^<' || o_dt || '>' ELSE '' END END"
sql("line_numbers", f"""ln AS (SELECT s, s_kind, substr(md5(s), 1, 1) AS part, row_number() OVER (PARTITION BY substr(md5(s), 1, 1) ORDER BY {_subject} || ' <' || p || '> ' || {_object} || ' .') AS line FROM g)
SELECT s AS uri, part, min(line) AS line FROM ln WHERE s_kind = 'iri' AND s IN (SELECT uri FROM ci UNION SELECT uri FROM q) GROUP BY s, part""")

# predicate orders by kind, styles, pages, functions of terms, verdict
_pl = lambda first, last: f"CASE p WHEN '{v.TYPE}' THEN -1 " + " ".join(f"WHEN '{p}' THEN {k}" for k, p in [*enumerate(first), *enumerate(last, 20000)]) + " ELSE 10000 END"
sql("turtle_lines_by_kind", f"""ku AS (SELECT DISTINCT s, CASE WHEN s IN (SELECT uri FROM c) THEN 'classes' WHEN s IN (SELECT uri FROM q) THEN 'properties' ELSE 'individuals' END AS kind FROM g),
tk AS (SELECT s, s_kind, kind, {_pp} AS pp, CASE kind WHEN 'classes' THEN {_pl([v.SUBCLASS, v.LABEL], [v.COMMENT])} WHEN 'properties' THEN {_pl([v.DOMAIN, v.RANGE], [v.SUBPROPERTY])} ELSE {_pl([EX + "totalPrice"], [v.LABEL])} END AS place,
string_agg(DISTINCT {_fmt}, ', ' ORDER BY {_fmt}) AS objects FROM g JOIN ku USING (s) GROUP BY ALL)
SELECT CASE WHEN s_kind = 'bnode' THEN '_:' || s ELSE {qname("s")} END AS subject, kind, row_number() OVER (PARTITION BY s ORDER BY place, pp) AS ord, pp || ' ' || objects AS line FROM tk""")
_ni = ORACLE_SQL["sel_named_individuals"][ORACLE_SQL["sel_named_individuals"].rindex("SELECT DISTINCT s AS uri") :]
sql("uml_instance_styles", f"""ty AS (SELECT * FROM (VALUES ('{EX}EventType_click', 'lime'), ('{v.OWL}NamedIndividual', 'pink')) AS t(class, own)),
gv AS (SELECT * FROM (VALUES ('{EX}Region_1', 'blue'), ('{EX}Nation_3', 'red'), ('{EX}Entity', 'grey'), ('{EX}EventType_click', 'olive'), ('{EX}type_LARGE', 'cyan'), ('{EX}type_ECONOMY', 'plum')) AS t(dst, style)),
dd AS (SELECT src, dst, 1 AS k FROM e UNION SELECT dd.src, e.dst, k + 1 FROM dd JOIN e ON dd.dst = e.src WHERE k < 12), dm AS (SELECT src, dst, min(k) AS k FROM dd GROUP BY src, dst),
ab AS (SELECT src AS class, style AS above FROM dm JOIN gv USING (dst) QUALIFY row_number() OVER (PARTITION BY src ORDER BY k, dst) = 1),
ft AS (SELECT s AS uri, min(o) AS class FROM g WHERE p = '{v.TYPE}' AND o_kind = 'iri' AND o NOT IN {_in(*CLASS_TYPES, *PROPERTY_TYPES)} GROUP BY s), ni AS ({_ni})
SELECT ni.uri, coalesce(own, above, 'black') AS style, CASE WHEN own IS NULL AND above IS NOT NULL THEN above WHEN ft.class IS NOT NULL THEN coalesce(gv.style, above, CASE WHEN starts_with(ft.class, '{EX}type_') THEN 'green' END, 'white') END AS text,
CASE WHEN own IS NOT NULL THEN 'type' WHEN above IS NOT NULL THEN 'inherited' ELSE 'default' END AS how
FROM ni LEFT JOIN ft ON ft.uri = ni.uri LEFT JOIN ty ON ty.class = ft.class LEFT JOIN ab ON ab.class = ft.class LEFT JOIN gv ON gv.dst = ft.class""")
_ps = f"CASE WHEN starts_with(uri, '{EX}supplies_1') THEN 'namespace' WHEN f OR a OR b THEN 'type' ELSE 'default' END"
sql("uml_property_styles", f"""qi AS (SELECT s AS uri, bool_or(o = '{v.OWL}FunctionalProperty') AS f, bool_or(o = '{v.OBJECT_PROPERTY}') AS a, bool_or(o = '{v.DATATYPE_PROPERTY}') AS b FROM g WHERE p = '{v.TYPE}' AND s_kind = 'iri' AND s IN (SELECT uri FROM q) GROUP BY s)
SELECT uri, CASE {_ps} WHEN 'namespace' THEN 'orange' WHEN 'default' THEN '#CCCCCC' ELSE CASE WHEN f THEN 'teal' WHEN a THEN 'navy' ELSE 'gold' END END AS style, {_ps} AS how FROM qi""")
_df = ORACLE_SQL["docs_files"][ORACLE_SQL["docs_files"].index("x AS (SELECT 1) ") + 16 :]
sql("docs_index", f"""{BEST}, df AS ({_df}) SELECT df.uri, kind, '- [' || coalesce(nullif(bl.x, ''), {qname('df.uri')}) || '](' || path || ')' || CASE WHEN coalesce(bd.x, '') = '' THEN '' WHEN length(bd.x) > 100 THEN ' — ' || substr(bd.x, 1, 100) || '...' ELSE ' — ' || bd.x END AS line
FROM df LEFT JOIN bl ON bl.uri = df.uri LEFT JOIN bd ON bd.uri = df.uri""")
_nl = "chr(10)"
_to = lambda x: _file("classes").replace(qname("uri"), qname(x))
_ls = lambda f: f"array_to_string(list_transform(string_split(supers, ' '), lambda y: {f}), {_nl})"
sql("docs_class_pages", f"""{DOCC} SELECT uri, {_file('classes')} AS path, '---' || {_nl} || 'title: ' || label || {_nl} || 'type: class' || {_nl} || CASE WHEN supers = '' THEN '' ELSE 'parents:' || {_nl} || {_ls("'  - ' || " + qname('y'))} || {_nl} END || '---' || {_nl} || {_nl} || '# ' || label || {_nl} || {_nl} || '**URI:** `' || uri || '`' || {_nl}
|| CASE WHEN coalesce(definition, '') = '' THEN '' ELSE {_nl} || definition || {_nl} END || CASE WHEN supers = '' THEN '' ELSE {_nl} || '## Superclasses' || {_nl} || {_nl} || {_ls("'- [' || " + qname('y') + " || '](' || " + _to('y') + " || ')'")} || {_nl} END AS page FROM dc""")
_some = lambda m, w: f"CASE WHEN {m} > 0 THEN CAST({m} AS VARCHAR) || ' {w}' END"
_m = lambda *names: f"(SELECT CAST(sum(n) AS BIGINT) FROM me WHERE metric IN {_in(*names)})"
sql("describe_verdict", f"""me AS MATERIALIZED ({ORACLE_SQL['describe_metrics']}), po AS ({ORACLE_SQL['owl_profile_text']}), im AS (SELECT count(DISTINCT o) AS n FROM g WHERE p = '{v.OWL}imports'),
vs AS (SELECT {_m('total_triples')} AS t, {_m('classes')} AS a, {_m('object_properties', 'datatype_properties', 'annotation_properties', 'rdf_properties')} AS b, {_m('individuals')} AS i)
SELECT concat_ws(' | ', display, concat_ws(', ', CAST(t AS VARCHAR) || ' triples', {_some('a', 'classes')}, {_some('b', 'properties')}, {_some('i', 'individuals')}), {_some('im.n', 'imports')}) AS verdict FROM po, vs, im""")
ORACLE_SQL["split_unmatched"] = f"WITH u AS (SELECT uri FROM ({ORACLE_SQL['split_assign']}) WHERE module = 'common') SELECT count(*) AS n, 'Unmatched entities (' || count(*) || '): ' || (SELECT string_agg(uri, ', ' ORDER BY uri) FROM (SELECT uri FROM u ORDER BY uri LIMIT 5)) || CASE WHEN count(*) > 5 THEN '...' ELSE '' END AS error FROM u HAVING count(*) > 0"
_num = f"CASE WHEN o_dt IN {_in(*(v.XSD + x for x in ('integer', 'decimal', 'float', 'double', 'nonNegativeInteger', 'positiveInteger', 'long', 'int')))} THEN TRY_CAST(o AS DOUBLE) END"
sql("bgp_functions", f"""lf AS (SELECT CASE WHEN o_lang <> '' THEN '{v.RDF}langString' WHEN o_dt <> '' THEN o_dt ELSE '{v.XSD}string' END AS datatype, CAST(lower(o_lang) = 'en' OR starts_with(lower(o_lang), 'en-') AS INT) AS english, {_num} AS x,
CASE WHEN contains(o, ' ') THEN split_part(o, ' ', 1) ELSE '' END AS before, CASE WHEN contains(o, ' ') THEN substr(o, instr(o, ' ') + 1) ELSE '' END AS after, url_encode(substr(o, 1, 20)) AS code FROM g WHERE o_kind = 'literal')
SELECT datatype, english, count(*) AS n, count(x) AS n_numbers, CAST(coalesce(sum(floor(x + 0.5)), 0) AS BIGINT) AS rounded, min(abs(x)) AS least, max(x) AS most, max(before) AS last_before, CAST(sum(length(after)) AS BIGINT) AS after_chars, max(code) AS last_code, count(DISTINCT code) AS codes FROM lf GROUP BY datatype, english""")
_type3 = f"CASE WHEN p = '{v.TYPE}' THEN 'type' WHEN p IN {_in(v.SUBCLASS, v.SUBPROPERTY)} THEN 'hierarchy' WHEN p IN {_in(v.DISJOINT, v.EQUIVALENT_CLASS)} THEN 'contradiction' ELSE 'value' END"
sql("merge_run_summary", f"""d3 AS MATERIALIZED (SELECT DISTINCT {_re('s', _iri_s)} AS s, s_kind, {_re('p', 'true')} AS p, {_re('o', _iri_o)} AS o, o_kind, o_dt, o_lang FROM h),
a3 AS MATERIALIZED (SELECT {T} FROM g UNION SELECT {T} FROM h UNION SELECT {T} FROM d3), c3 AS (SELECT s, p, {_type3} AS t FROM a3 WHERE s_kind = 'iri' GROUP BY s, p HAVING count(*) > 1)
SELECT 'source' AS measure, 'core' AS name, count(*) AS n FROM (SELECT DISTINCT {T} FROM g) UNION ALL SELECT 'source', 'extension', count(*) FROM (SELECT DISTINCT {T} FROM h) UNION ALL SELECT 'source', 'draft', count(*) FROM d3
UNION ALL SELECT 'conflicts', t, count(*) FROM c3 GROUP BY t UNION ALL SELECT 'conflicts', 'resolved', count(*) FROM c3 UNION ALL SELECT 'conflicts', 'unresolved', 0 UNION ALL SELECT 'result', 'triples', count(*) FROM a3""", True)
sql("merge_run_winners", f"{conflict_sql(f"p NOT IN {_in(v.COMMENT, EX + 'contains')}")} SELECT v.s, v.p, conflict_type, n_values, v.o AS winner FROM v JOIN cf USING (s, p) QUALIFY row_number() OVER (PARTITION BY v.s, v.p ORDER BY last DESC, term) = 1", True)
sql("merge_run_marked", f"SELECT p, count(*) AS n FROM (SELECT {T} FROM g UNION SELECT {T} FROM h) WHERE p <> '{v.IMPORTS}' GROUP BY p", True)
sql("split_run", f"""{ASSIGN}, nd AS (SELECT DISTINCT a.module, b.module AS needs FROM g JOIN asg a ON g.s = a.uri JOIN asg b ON g.o = b.uri AND g.o_kind = 'iri' WHERE a.module <> b.module),
hm AS (SELECT DISTINCT g.s, asg.module FROM g JOIN asg ON g.o = asg.uri AND asg.kind = 'class' WHERE p = '{v.TYPE}' AND g.s NOT IN (SELECT uri FROM asg)),
tr AS (SELECT DISTINCT module, {T} FROM g JOIN asg ON g.s = asg.uri UNION ALL SELECT DISTINCT 'data_' || module, {T} FROM g JOIN hm USING (s)),
hd AS (SELECT module, 'head' AS s, '{v.TYPE}' AS p FROM (SELECT DISTINCT module FROM asg) UNION ALL SELECT module, 'head', '{v.IMPORTS}' FROM nd UNION ALL SELECT DISTINCT module, 'head', '{v.IMPORTS}' FROM asg WHERE module = 'nations')
SELECT module, count(*) AS n, count(DISTINCT s) AS subjects, count(*) FILTER (WHERE p = '{v.IMPORTS}') AS imports FROM (SELECT module, s, p FROM tr UNION ALL SELECT module, s, p FROM hd) GROUP BY module""")
sql("uml_together", f"SELECT DISTINCT dst AS \"group\", 1 AS part, '  class ' || {_dot('src')} AS line FROM e UNION ALL SELECT DISTINCT dst, 0, 'together {{' FROM e UNION ALL SELECT DISTINCT dst, 2, '}}' FROM e")
sql("uml_hidden_links", f"""hl AS (SELECT src, dst, length(src) % 4 AS k FROM e)
SELECT {_dot('src')} || CASE WHEN k = 1 THEN ' -[hidden,down]-> ' ELSE ' -[hidden]-> ' END || {_dot('dst')} AS line FROM hl, range(2) r(i) WHERE i < CASE WHEN k = 3 THEN 1 ELSE k END""")
_ends = "src IN (SELECT uri FROM ci) AND dst IN (SELECT uri FROM ci)"
sql("uml_layout_links", f"""ll AS (SELECT d.o AS src, r.o AS dst, d.s AS path FROM g d JOIN g r ON r.s = d.s AND r.p = '{v.RANGE}' WHERE d.p = '{v.DOMAIN}')
SELECT DISTINCT {_dot('src')} || ' -left-|> ' || {_dot('dst')} AS line FROM e WHERE {_ends} UNION ALL SELECT DISTINCT {_dot('src')} || ' -> ' || {_dot('dst')} || ' : ' || {_dot('path')} FROM ll WHERE {_ends}""")
sql("prefixes_declared", f"""{_SPACES}, pd AS (SELECT pre AS prefix, ns FROM sp WHERE pre <> 'nation_1' UNION ALL SELECT unnest(['nation_1', 'v2']), 'http://example.org/v2#')
SELECT prefix, ns, CAST(CASE prefix WHEN 'v2' THEN 0 WHEN 'nation_3' THEN 1 WHEN 'customer_2' THEN 2 ELSE 3 END AS INT) AS place FROM pd""")
