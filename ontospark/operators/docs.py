"""Documentation: entity records, search entries, Markdown, and diagram edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import vocab as v
from ..sources.scratch import written
from . import closure, describe, select


def joined(flag, value):
    return F.array_join(F.array_sort(F.collect_set(F.when(flag, value))), " ")


def class_records(g: DataFrame) -> DataFrame:
    """``uri, label, definition, supers, n_subclasses, n_domain_of, n_range_of, n_instances``: own triples and those that point here, one grouping each."""
    c = select.classes(g, True)
    own = g.where(F.col("p").isin([*v.LABELS, *v.DEFINITIONS, v.SUBCLASS])).groupBy(F.col("s").alias("uri")).agg(
        describe.best_literal(v.LABELS).alias("label"), describe.best_literal(v.DEFINITIONS).alias("definition"),
        joined((F.col("p") == v.SUBCLASS) & (F.col("o_kind") == "iri"), F.col("o")).alias("supers"),
    )
    n = lambda p: F.sum(F.when(F.col("p") == p, 1).otherwise(0))
    back = g.where(F.col("p").isin(v.SUBCLASS, v.DOMAIN, v.RANGE, v.TYPE) & (F.col("s_kind") == "iri")).groupBy(F.col("o").alias("uri")).agg(n(v.SUBCLASS).alias("n_subclasses"), n(v.DOMAIN).alias("n_domain_of"), n(v.RANGE).alias("n_range_of"), n(v.TYPE).alias("n_instances"))
    out = c.join(own, "uri", "left").join(back, "uri", "left")
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("n_subclasses", "n_domain_of", "n_range_of", "n_instances")]
    return out.select("uri", F.coalesce("label", terms.local_name(F.col("uri"))).alias("label"), "definition", F.coalesce("supers", F.lit("")).alias("supers"), *zero)


def property_records(g: DataFrame) -> DataFrame:
    """``uri, kind, domains, ranges, supers``; the kind by precedence object, datatype, annotation, plain."""
    iri = F.col("o_kind") == "iri"
    kind = F.min(F.when(F.col("p") == v.TYPE, F.when(F.col("o") == v.OBJECT_PROPERTY, 0).when(F.col("o") == v.DATATYPE_PROPERTY, 1).when(F.col("o") == v.ANNOTATION_PROPERTY, 2).when(F.col("o") == v.RDF_PROPERTY, 3)))
    own = g.where(F.col("p").isin(v.TYPE, v.DOMAIN, v.RANGE, v.SUBPROPERTY) & (F.col("s_kind") == "iri")).groupBy(F.col("s").alias("uri")).agg(
        kind.alias("k"), *(joined((F.col("p") == p) & iri, F.col("o")).alias(n) for p, n in ((v.DOMAIN, "domains"), (v.RANGE, "ranges"), (v.SUBPROPERTY, "supers")))
    )
    name = F.when(F.col("k") == 0, "object").when(F.col("k") == 1, "datatype").when(F.col("k") == 2, "annotation").otherwise("rdf")
    return own.where("k IS NOT NULL").select("uri", name.alias("kind"), "domains", "ranges", "supers")


def instance_records(g: DataFrame) -> DataFrame:
    """``uri, types, n_values``: named individuals, their types and how many other triples they have."""
    own = g.where("s_kind = 'iri'").groupBy(F.col("s").alias("uri")).agg(joined(F.col("p") == v.TYPE, F.col("o")).alias("types"), F.sum(F.when(F.col("p") == v.TYPE, 0).otherwise(1)).alias("n_values"))
    return select.named_individuals(g).join(own, "uri")


def search_entries(g: DataFrame) -> DataFrame:
    """``uri, label, words``: search words of classes and properties from label, definition and name, sorted."""
    e = select.classes(g, True).unionByName(select.properties(g, True)).distinct()
    told = describe.labels(g)
    label = F.coalesce("label", terms.local_name(F.col("uri")))
    words = terms.keywords(F.concat_ws(" ", label, F.coalesce("definition", F.lit("")), terms.local_name(F.col("uri"))))
    return e.join(told, "uri", "left").select("uri", label.alias("label"), F.array_join(F.array_sort(words), " ").alias("words"))


def markdown(g: DataFrame) -> DataFrame:
    """``uri, page``: a Markdown page for each class; definitions of over 100 characters are cut in lists, not here."""
    c = class_records(g)
    supers = F.when(F.col("supers") == "", "").otherwise(F.concat(F.lit("\n\n**Superclasses:** "), "supers"))
    return c.select("uri", F.concat(F.lit("# "), "label", F.lit("\n\n`"), "uri", F.lit("`"), F.when(F.col("definition").isNotNull(), F.concat(F.lit("\n\n"), "definition")).otherwise(""), supers, F.lit("\n")).alias("page"))


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each record as a JSON string."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def inherited_properties(g: DataFrame) -> DataFrame:
    """``class, property``: properties whose domain is above the class and not the class itself."""
    d = g.where((F.col("p") == v.DOMAIN) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select(F.col("s").alias("property"), F.col("o").alias("dst"))
    above = closure.reach(select.edges(g), to=d.select(F.col("dst").alias("uri"))).where("src <> dst")
    return above.join(d, "dst").select(F.col("src").alias("class"), "property").distinct().join(d.select(F.col("dst").alias("class"), "property"), ["class", "property"], "left_anti")


def inherited_property_counts(g: DataFrame) -> DataFrame:
    """``class, n, first_property`` of ``inherited_properties``, without its pairs.

    Classes below the same domains have the same properties: they are told by a digest of those domains and counted once, by one class of each kind. A class with
    properties of its own is a kind by itself.
    """
    d = g.where((F.col("p") == v.DOMAIN) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select(F.col("s").alias("property"), F.col("o").alias("dst")).distinct()
    d = written(d, "domains")
    own = d.select(F.col("dst").alias("src"), F.col("dst").alias("own")).distinct()
    above = written(closure.reach(select.edges(g), to=d.select(F.col("dst").alias("uri"))).where("src <> dst").select("src", "dst"), "above")
    digest = lambda salt: F.sum(F.xxhash64("dst", F.lit(salt)).cast("decimal(20,0)"))
    kinds = above.groupBy("src").agg(F.count("*").alias("k"), digest("a").alias("a"), digest("b").alias("b")).join(own, "src", "left")
    kinds = written(kinds.select(F.col("src").alias("class"), F.sha2(F.concat_ws(" ", "k", "a", "b", F.coalesce("own", F.lit(""))), 256).alias("kind")), "kinds")
    one = kinds.groupBy("kind").agg(F.min("class").alias("class"))
    pairs = above.join(one.select(F.col("class").alias("src"), "kind"), "src").join(d, "dst").select("kind", F.col("src").alias("class"), "property").distinct()
    pairs = pairs.join(d.select(F.col("dst").alias("class"), "property"), ["class", "property"], "left_anti")
    counted = pairs.groupBy("kind").agg(F.count("*").alias("n"), F.min("property").alias("first_property"))
    return kinds.join(counted, "kind").select("class", "n", "first_property")


def domain_properties(g: DataFrame, chosen: DataFrame) -> DataFrame:
    """``uri`` of the properties with a domain among ``chosen.uri``."""
    return g.where(F.col("p") == v.DOMAIN).join(chosen.select(F.col("uri").alias("o")), "o", "left_semi").select(F.col("s").alias("uri")).distinct()


def connected_properties(g: DataFrame, chosen: DataFrame) -> DataFrame:
    """The same with a range among them too."""
    r = g.where(F.col("p") == v.RANGE).join(chosen.select(F.col("uri").alias("o")), "o", "left_semi").select(F.col("s").alias("uri"))
    return domain_properties(g, chosen).join(r, "uri", "left_semi")


def diagram_edges(g: DataFrame, chosen: DataFrame) -> DataFrame:
    """``line``: inheritance and association arrows between the chosen classes, as PlantUML."""
    keep = lambda df, c: df.join(chosen.select(F.col("uri").alias(c)), c, "left_semi")
    name = terms.local_name
    up = keep(keep(select.edges(g), "src"), "dst").select(F.concat(name(F.col("src")), F.lit(" --|> "), name(F.col("dst"))).alias("line"))
    d = g.where(F.col("p") == v.DOMAIN).select(F.col("s").alias("path"), F.col("o").alias("src"))
    r = g.where(F.col("p") == v.RANGE).select(F.col("s").alias("path"), F.col("o").alias("dst"))
    link = keep(keep(d.join(r, "path"), "src"), "dst").select(F.concat(name(F.col("src")), F.lit(" --> "), name(F.col("dst")), F.lit(" : "), name(F.col("path"))).alias("line"))
    return up.unionByName(link)


def class_lines(g: DataFrame, chosen: DataFrame) -> DataFrame:
    """``line``: a PlantUML class for each chosen one with its datatype properties as attributes."""
    d = g.where(F.col("p") == v.DOMAIN).select(F.col("s").alias("path"), F.col("o").alias("uri"))
    r = g.where((F.col("p") == v.RANGE) & F.col("o").startswith(v.XSD)).select(F.col("s").alias("path"), terms.local_name(F.col("o")).alias("type"))
    own = d.join(r, "path").groupBy("uri").agg(F.array_join(F.array_sort(F.collect_set(F.concat(terms.local_name(F.col("path")), F.lit(" : "), "type"))), "; ").alias("attributes"))
    return chosen.join(own, "uri", "left").select(F.concat(F.lit("class "), terms.local_name(F.col("uri")), F.lit(" {"), F.coalesce("attributes", F.lit("")), F.lit("}")).alias("line"))


def instances_of(g: DataFrame, chosen: DataFrame) -> DataFrame:
    """``uri, class``: what is typed by the chosen classes and no class itself."""
    kinds = g.where((F.col("p") == v.TYPE) & (F.col("s_kind") == "iri")).select(F.col("s").alias("uri"), F.col("o").alias("class"))
    return kinds.join(chosen.select(F.col("uri").alias("class")), "class", "left_semi").join(select.classes(g), "uri", "left_anti").select("uri", "class")


def type_arrows(g: DataFrame, chosen: DataFrame, prefixes: dict[str, str], colour: str = "#FF0000") -> DataFrame:
    """``line``: a coloured arrow from each instance to its class."""
    name = lambda c: F.replace(terms.qname(F.col(c), prefixes), F.lit(":"), F.lit("."))
    return instances_of(g, chosen).select(F.concat(name("uri"), F.lit(f" -u[{colour}]-> "), name("class"), F.lit(" : <<rdf:type>>")).alias("line"))


def literal_notes(g: DataFrame, chosen: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``line``: each literal of the instances' datatype properties as a note; a note's name is the hash of its triple, so
    no task numbers all of them."""
    inst = instances_of(g, chosen).select(F.col("uri").alias("s")).distinct()
    said = select.with_predicates(g, [v.DATATYPE_PROPERTY]).where("o_kind = 'literal'").join(inst.hint("merge"), "s", "left_semi").select("s", "p", "o")
    note = F.concat(F.lit("N_"), F.substring(F.sha2(F.concat_ws("|", "s", "p", "o"), 256), 1, 12))
    return said.select(F.concat(F.lit('note "'), F.replace("o", F.lit('"'), F.lit("'")), F.lit('" as '), note, F.lit(" / "), F.replace(terms.qname(F.col("s"), prefixes), F.lit(":"), F.lit(".")), F.lit(" .u. "), note, F.lit(" : <<"), terms.qname(F.col("p"), prefixes), F.lit(">>")).alias("line"))


def styles(g: DataFrame, by_class: DataFrame, by_namespace: list[tuple[str, str]], default: str) -> DataFrame:
    """``uri, style, how`` of the classes: an own style, else the nearest styled class above (ties: the smallest URI), else
    that of the first namespace, else the default. ``by_class`` has ``uri, style``."""
    c = select.classes(g, True)
    marks = by_class.select(F.col("uri").alias("mark"), F.col("style").alias("above"))
    above = closure.nearest(select.edges(g), by_class).where("dist > 0").join(marks, "mark").select("uri", "above")
    spaced = F.lit(None).cast("string")
    for ns, style in reversed(by_namespace):
        spaced = F.when(F.col("uri").startswith(ns), style).otherwise(spaced)
    own = c.join(by_class.select("uri", F.col("style").alias("own")), "uri", "left").join(above, "uri", "left").withColumn("spaced", spaced)
    how = F.when(F.col("own").isNotNull(), "own").when(F.col("above").isNotNull(), "inherited").when(F.col("spaced").isNotNull(), "namespace").otherwise("default")
    return own.select("uri", F.coalesce("own", "above", "spaced", F.lit(default)).alias("style"), how.alias("how"))


def annotations(g: DataFrame) -> DataFrame:
    """``uri, name, values``: the values of the standard annotations of each subject, sorted."""
    name = F.element_at(F.create_map(*[F.lit(x) for n, p in v.ANNOTATIONS.items() for x in (p, n)]), F.col("p"))
    rows = g.where(F.col("p").isin(list(v.ANNOTATIONS.values())) & (F.col("o_kind") != "bnode"))
    return rows.groupBy(F.col("s").alias("uri"), name.alias("name")).agg(F.array_join(F.array_sort(F.collect_list("o")), " | ").alias("values"))


def files(g: DataFrame, prefixes: dict[str, str], include: list[str] | None = None, extension: str = ".md", base_url: str = "") -> DataFrame:
    """``uri, kind, path``: where the page of each entity goes; ``include`` limits the kinds, ``properties`` stands for all three of them."""
    wanted = [y for x in include or list(v.FOLDERS) for y in (("object_property", "datatype_property", "annotation_property") if x == "properties" else (x,))]
    kinds = [("class", v.CLASS_TYPES), ("object_property", [v.OBJECT_PROPERTY]), ("datatype_property", [v.DATATYPE_PROPERTY]), ("annotation_property", [v.ANNOTATION_PROPERTY])]
    parts = [select.typed(g, types, True).select("uri", F.lit(k).alias("kind")) for k, types in kinds if k in wanted]
    if "instance" in wanted:
        parts.append(select.named_individuals(g).select("uri", F.lit("instance").alias("kind")))
    all_ = parts[0]
    for x in parts[1:]:
        all_ = all_.unionByName(x)
    folder = F.element_at(F.create_map(*[F.lit(x) for pair in v.FOLDERS.items() for x in pair]), F.col("kind"))
    path = F.concat(folder, F.lit("/"), terms.file_name(terms.qname(F.col("uri"), prefixes)), F.lit(extension))
    return all_.select("uri", "kind", (F.concat(F.lit(base_url + "/"), path) if base_url else path).alias("path"))


def instance_links(g: DataFrame, chosen: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``line``: an arrow for each object property between two instances of the chosen classes."""
    inst = instances_of(g, chosen).select("uri").distinct()
    links = select.with_predicates(g, [v.OBJECT_PROPERTY]).where("o_kind = 'iri'").select("s", "p", "o")
    links = links.join(inst.withColumnRenamed("uri", "s").hint("merge"), "s", "left_semi").join(inst.withColumnRenamed("uri", "o").hint("merge"), "o", "left_semi")  # as many as all instances: never broadcast
    dot = lambda c: F.replace(terms.qname(F.col(c), prefixes), F.lit(":"), F.lit("."))
    return links.select(F.concat(dot("s"), F.lit(" --> "), dot("o"), F.lit(" : "), terms.qname(F.col("p"), prefixes)).alias("line"))


def shown_labels(g: DataFrame, prefixes: dict[str, str], camel: bool = False) -> DataFrame:
    """``uri, shown``: the smallest label of each subject, in camel case if wanted, else its qualified name."""
    told = g.where((F.col("p") == v.LABEL) & (F.col("o_kind") == "literal")).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("label"))
    words = F.split("label", r"\s+")
    text = F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2))))), "") if camel else F.col("label")
    subjects = g.where("s_kind = 'iri'").select(F.col("s").alias("uri")).distinct()
    return subjects.join(told, "uri", "left").select("uri", F.coalesce(text, terms.qname(F.col("uri"), prefixes)).alias("shown"))


def stereotypes(g: DataFrame, chosen: DataFrame, prefixes: dict[str, str], most: int = 3) -> DataFrame:
    """``uri, stereotype``: the first types of each instance by name."""
    own = instances_of(g, chosen).groupBy("uri").agg(F.array_sort(F.collect_set(terms.qname(F.col("class"), prefixes))).alias("types"))
    return own.select("uri", F.concat(F.lit("<<"), F.array_join(F.slice("types", 1, most), ", "), F.lit(">>")).alias("stereotype"))


def page_counts(found: DataFrame) -> DataFrame:
    """``kind, n``: the pages of ``files`` and their sum as ``total``."""
    each = found.groupBy("kind").agg(F.count("*").alias("n"))
    return each.unionByName(each.agg(F.lit("total").alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def property_arrows(g: DataFrame, chosen: DataFrame) -> DataFrame:
    """``line``: an inheritance arrow for each subproperty among the chosen properties."""
    e = select.edges(g, v.SUBPROPERTY)
    for end in ("src", "dst"):
        e = e.join(chosen.select(F.col("uri").alias(end)).distinct(), end, "left_semi")
    return e.select(F.concat(terms.local_name(F.col("src")), F.lit(" --|> "), terms.local_name(F.col("dst"))).alias("line"))


def instance_styles(g: DataFrame, by_type: DataFrame, by_class: DataFrame, by_namespace: list[tuple[str, str]], default: str, class_default: str, class_text: bool = False) -> DataFrame:
    """``uri, style, text, how`` of the named individuals.

    An individual's first type (the smallest URI that is no kind of class or property) decides: a style of the type itself for instances
    (``by_type``), else that of the nearest styled class above the type (``by_class``; ties: the smallest URI), which is the text's colour
    too, else the default. With ``class_text`` the other texts have the style of the type as a class: its own, the nearest above, that of
    the first namespace, or ``class_default``; otherwise none.
    """
    first = g.where((F.col("p") == v.TYPE) & (F.col("o_kind") == "iri") & ~F.col("o").isin([*v.CLASS_TYPES, *v.PROPERTY_TYPES])).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("class"))
    marks = by_class.select(F.col("uri").alias("mark"), F.col("style").alias("above"))
    # one step up, then the nearest from there: a style of the type itself doesn't count, unless a cycle leads back to it
    near = closure.nearest(select.edges(g), by_class).select(F.col("uri").alias("dst"), "dist", "mark")
    above = select.edges(g).join(near, "dst").groupBy(F.col("src").alias("class")).agg(F.min_by("mark", F.struct("dist", "mark")).alias("mark")).join(marks, "mark").select("class", "above")
    rows = select.named_individuals(g).join(first, "uri", "left")
    for params, name in ((by_type, "own"), (by_class, "as_class")):
        rows = rows.join(params.select(F.col("uri").alias("class"), F.col("style").alias(name)), "class", "left")
    rows = rows.join(above, "class", "left")
    spaced = F.lit(class_default)
    for ns, style in reversed(by_namespace):
        spaced = F.when(F.col("class").startswith(ns), style).otherwise(spaced)
    how = F.when(F.col("own").isNotNull(), "type").when(F.col("above").isNotNull(), "inherited").otherwise("default")
    of_class = F.when(F.col("class").isNotNull(), F.coalesce("as_class", "above", spaced)) if class_text else F.lit(None).cast("string")
    text = F.when(how == "inherited", F.col("above")).otherwise(of_class)
    return rows.select("uri", F.coalesce("own", "above", F.lit(default)).alias("style"), text.alias("text"), how.alias("how"))


def property_styles(g: DataFrame, by_namespace: list[tuple[str, str]], by_kind: list[tuple[str, str]], default: str = "#CCCCCC") -> DataFrame:
    """``uri, style, how`` of the properties: the style of the first namespace that fits, else of the first listed type that the property has, else the default."""
    spaced = F.lit(None).cast("string")
    for ns, style in reversed(by_namespace):
        spaced = F.when(F.col("uri").startswith(ns), style).otherwise(spaced)
    has = F.lit(None).cast("int")
    for k, (kind, _) in reversed(list(enumerate(by_kind))):
        has = F.when(F.col("o") == kind, k).otherwise(has)
    typed = g.where((F.col("p") == v.TYPE) & (F.col("s_kind") == "iri")).groupBy(F.col("s").alias("uri")).agg(F.max(F.col("o").isin(v.PROPERTY_TYPES)).alias("is"), F.min(has).alias("k")).where("is")
    of_kind = F.get(F.array(*[F.lit(s) for _, s in by_kind]), F.col("k")) if by_kind else F.lit(None).cast("string")
    how = F.when(spaced.isNotNull(), "namespace").when(of_kind.isNotNull(), "type").otherwise("default")
    return typed.select("uri", F.coalesce(spaced, of_kind, F.lit(default)).alias("style"), how.alias("how"))


def link(shown, path):
    """A Markdown link."""
    return F.concat(F.lit("["), shown, F.lit("]("), path, F.lit(")"))


def front_matter(**fields):
    """The lines between ``---`` that begin a page: a column for each name, an array as a list."""
    lines = [F.lit("---")]
    for name, (value, many) in fields.items():
        lines.append(F.array_join(F.concat(F.array(F.lit(f"{name}:")), F.transform(value, lambda x: F.concat(F.lit("  - "), x))), "\n") if many else F.concat(F.lit(f"{name}: "), value))
    return F.concat(F.array_join(F.array(*lines, F.lit("---")), "\n"), F.lit("\n"))


def index_lines(g: DataFrame, prefixes: dict[str, str], include: list[str] | None = None, cut: int = 100) -> DataFrame:
    """``uri, kind, line``: each entity as an entry of the index, a link to its page with its label or else its qualified name.

    The definition follows, if it isn't empty; one of over ``cut`` characters is cut and marked.
    """
    found = files(g, prefixes, include)
    told = describe.labels(g).withColumn("definition", F.when(F.length("definition") > cut, F.concat(F.substring("definition", 1, cut), F.lit("..."))).otherwise(F.col("definition")))
    shown = F.coalesce(F.when(F.col("label") != "", F.col("label")), terms.qname(F.col("uri"), prefixes))
    desc = F.when(F.col("definition") != "", F.concat(F.lit(" — "), "definition")).otherwise("")
    return found.join(told, "uri", "left").select("uri", "kind", F.concat(F.lit("- "), link(shown, F.col("path")), desc).alias("line"))


def class_pages(g: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``uri, path, page``: a page for each class with front matter (title, type and, where there are any, its parents) and its superclasses as links."""
    q = lambda x: terms.qname(x, prefixes)
    to = lambda x: F.concat(F.lit(v.FOLDERS["class"] + "/"), terms.file_name(q(x)), F.lit(".md"))
    parents = F.when(F.col("supers") == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.split("supers", " "))
    c = class_records(g).withColumn("parents", parents)
    head = F.when(F.size("parents") > 0, front_matter(title=(F.col("label"), False), type=(F.lit("class"), False), parents=(F.transform("parents", q), True))).otherwise(front_matter(title=(F.col("label"), False), type=(F.lit("class"), False)))
    body = F.concat(F.lit("\n# "), "label", F.lit("\n\n**URI:** `"), "uri", F.lit("`\n"), F.when(F.col("definition") != "", F.concat(F.lit("\n"), "definition", F.lit("\n"))).otherwise(""))
    above = F.when(F.size("parents") > 0, F.concat(F.lit("\n## Superclasses\n\n"), F.array_join(F.transform("parents", lambda x: F.concat(F.lit("- "), link(q(x), to(x)))), "\n"), F.lit("\n"))).otherwise("")
    return c.select("uri", to(F.col("uri")).alias("path"), F.concat(head, body, above).alias("page"))


#: The directions of a diagram that have a directive, by the names that a layout may give them.
DIRECTIONS = {
    "top_to_bottom": "top to bottom direction", "ttb": "top to bottom direction", "tb": "top to bottom direction",
    "left_to_right": "left to right direction", "ltr": "left to right direction", "lr": "left to right direction",
}
#: Other names of directions, which have no directive; an unknown name means top to bottom.
UNSUPPORTED = ["bottom_to_top", "btt", "bt", "right_to_left", "rtl", "rl"]
#: How lines may run, and where arrows of hierarchies may point.
LINE_TYPES, ARROWS = ["ortho", "polyline", "spline"], ["up", "down", "left", "right"]


def directives(direction: str = "top_to_bottom", hide_empty: bool = False, line_type: str | None = None, group_inheritance: int = 0, spacing: dict[str, object] | None = None) -> list[str]:
    """The lines at the head of a diagram; an unknown line type has none."""
    name = direction.lower()
    out = [] if name in UNSUPPORTED else [DIRECTIONS.get(name, DIRECTIONS["ttb"])]
    out += ["hide empty members"] if hide_empty else []
    out += [f"skinparam linetype {line_type.lower()}"] if line_type and line_type.lower() in LINE_TYPES else []
    out += [f"skinparam groupInheritance {group_inheritance}"] if group_inheritance > 0 else []
    return out + [f"skinparam {k} {x}" for k, x in (spacing or {}).items()]


def arrow(kind: Column, direction: str = "up", shown: bool = True) -> Column:
    """The arrow of a link: hierarchies (``subclass``, ``instance``) point ``direction``, upward if that is unknown."""
    way = direction.lower() if direction.lower() in ARROWS else "up"
    return F.when(F.lit(not shown), "--").when(kind.isin("subclass", "instance"), f"-{way}-|>").otherwise("->")


def _dotted(uri: Column, prefixes: dict[str, str]) -> Column:
    return F.replace(terms.qname(uri, prefixes), F.lit(":"), F.lit("."))


def together(groups: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``group, part, line`` for ``group, uri``: classes to place side by side, as the lines of a block (part 0, its members, part 2).

    Lines stay rows, so no group is gathered. A class counts once in a group; null groups and null classes make none.
    """
    rows = groups.where("group IS NOT NULL AND uri IS NOT NULL").select("group", "uri").distinct()
    inner = rows.select("group", F.lit(1).alias("part"), F.concat(F.lit("  class "), _dotted(F.col("uri"), prefixes)).alias("line"))
    ends = rows.select("group").distinct().select("group", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("together {").alias("line")), F.struct(F.lit(2).alias("part"), F.lit("}").alias("line")))).alias("x"))
    return inner.unionByName(ends.select("group", "x.part", "x.line"))


def hidden_links(hints: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``line`` for ``src, dst, direction, weight``: as many hidden links as the weight says (null: one; below one: none), with a direction if there is one."""
    way = F.when(F.col("direction").isNull() | (F.col("direction") == ""), "-[hidden]->").otherwise(F.concat(F.lit("-[hidden,"), "direction", F.lit("]->")))
    line = F.concat_ws(" ", _dotted(F.col("src"), prefixes), way, _dotted(F.col("dst"), prefixes))
    often = F.coalesce(F.col("weight").cast("int"), F.lit(1))
    return hints.where("src IS NOT NULL AND dst IS NOT NULL").where(often > 0).select(line.alias("line"), F.explode(F.sequence(F.lit(1), often)).alias("_")).select("line")


def layout_links(g: DataFrame, chosen: DataFrame, prefixes: dict[str, str], direction: str = "up") -> DataFrame:
    """``line``: superclass links and associations between the chosen classes with arrows of a layout."""
    keep = lambda df, c: df.join(chosen.select(F.col("uri").alias(c)), c, "left_semi")
    up = select.edges(g).select("src", "dst", F.lit("subclass").alias("kind"), F.lit("").alias("label"))
    d = g.where(F.col("p") == v.DOMAIN).select(F.col("s").alias("path"), F.col("o").alias("src"))
    r = g.where(F.col("p") == v.RANGE).select(F.col("s").alias("path"), F.col("o").alias("dst"))
    link = d.join(r, "path").select("src", "dst", F.lit("object_property").alias("kind"), F.concat(F.lit(" : "), _dotted(F.col("path"), prefixes)).alias("label"))
    both = keep(keep(up.unionByName(link), "src"), "dst").distinct()
    return both.select(F.concat(_dotted(F.col("src"), prefixes), F.lit(" "), arrow(F.col("kind"), direction), F.lit(" "), _dotted(F.col("dst"), prefixes), "label").alias("line"))
