"""The vocabularies' terms that the operators know."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
DCTERMS = "http://purl.org/dc/terms/"
DC = "http://purl.org/dc/elements/1.1/"
CC = "http://creativecommons.org/ns#"
SH = "http://www.w3.org/ns/shacl#"
BUILTIN = [RDF, RDFS, OWL, XSD]

TYPE, LABEL, COMMENT = RDF + "type", RDFS + "label", RDFS + "comment"
FIRST, REST, NIL = RDF + "first", RDF + "rest", RDF + "nil"
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"
OWL_CLASS, RDFS_CLASS = OWL + "Class", RDFS + "Class"
OBJECT_PROPERTY, DATATYPE_PROPERTY, ANNOTATION_PROPERTY = OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty"
RDF_PROPERTY = RDF + "Property"
ONTOLOGY, RESTRICTION, NAMED_INDIVIDUAL = OWL + "Ontology", OWL + "Restriction", OWL + "NamedIndividual"
FUNCTIONAL, SYMMETRIC, INVERSE_OF = OWL + "FunctionalProperty", OWL + "SymmetricProperty", OWL + "inverseOf"
EQUIVALENT_CLASS, DISJOINT, ONE_OF, COMPLEMENT = OWL + "equivalentClass", OWL + "disjointWith", OWL + "oneOf", OWL + "complementOf"
ON_PROPERTY, MIN_CARD, MAX_CARD, CARD = OWL + "onProperty", OWL + "minCardinality", OWL + "maxCardinality", OWL + "cardinality"
SOME_VALUES, ALL_VALUES = OWL + "someValuesFrom", OWL + "allValuesFrom"
MIN_QUALIFIED, MAX_QUALIFIED, QUALIFIED = OWL + "minQualifiedCardinality", OWL + "maxQualifiedCardinality", OWL + "qualifiedCardinality"
ON_CLASS, ON_DATA_RANGE = OWL + "onClass", OWL + "onDataRange"
DEPRECATED, IMPORTS, VERSION_INFO, VERSION_IRI = OWL + "deprecated", OWL + "imports", OWL + "versionInfo", OWL + "versionIRI"
REPLACED_BY = DCTERMS + "isReplacedBy"
PREF_LABEL, DEFINITION = SKOS + "prefLabel", SKOS + "definition"

CLASS_TYPES = [OWL_CLASS, RDFS_CLASS]
PROPERTY_TYPES = [OBJECT_PROPERTY, DATATYPE_PROPERTY, ANNOTATION_PROPERTY, RDF_PROPERTY]
TOP_CLASSES = [OWL + "Thing", RDFS + "Resource"]
LABELS = [LABEL, PREF_LABEL]
DEFINITIONS = [COMMENT, DEFINITION, DCTERMS + "description"]
HEADER_NOTES = [LABEL, COMMENT, VERSION_INFO, VERSION_IRI]

#: Metrics of which more is better, and less.
HIGHER = [
    "basic.classes", "basic.object_properties", "basic.datatype_properties",
    "documentation.classes_labelled", "documentation.classes_labelled_pct", "documentation.classes_documented", "documentation.classes_documented_pct",
    "documentation.properties_labelled", "documentation.properties_labelled_pct",
    "properties.with_domain", "properties.with_range", "properties.domain_coverage", "properties.range_coverage",
]
LOWER = ["hierarchy.orphan_classes", "hierarchy.orphan_rate", "connectivity.isolated_classes"]

#: What counts as an expressive construct, by type of the subject, or by predicate.
EXPRESSIVE_TYPES = [RESTRICTION, OWL + "AllDisjointClasses", OWL + "AllDifferent"]
EXPRESSIVE_PREDICATES = [
    EQUIVALENT_CLASS, DISJOINT, OWL + "unionOf", OWL + "intersectionOf", COMPLEMENT, ONE_OF,
    OWL + "hasValue", SOME_VALUES, ALL_VALUES, MIN_CARD, MAX_CARD, CARD,
    OWL + "minQualifiedCardinality", OWL + "maxQualifiedCardinality", OWL + "qualifiedCardinality", OWL + "hasSelf", OWL + "propertyChainAxiom", OWL + "hasKey",
]
BASIC_TYPES = [ONTOLOGY, OWL_CLASS, OBJECT_PROPERTY, DATATYPE_PROPERTY, ANNOTATION_PROPERTY, NAMED_INDIVIDUAL]
CHARACTERISTICS = [FUNCTIONAL, OWL + "InverseFunctionalProperty", OWL + "TransitiveProperty", SYMMETRIC, OWL + "AsymmetricProperty", OWL + "ReflexiveProperty", OWL + "IrreflexiveProperty"]

#: Words that search keywords leave out.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must shall can need "
    "of to in for on with at by from as or and but if this that which who whom whose what when where why how "
    "all each every both few more most other some such no not only same so than too very just also any"
).split()


#: Prefixes of properties in translation files.
TRANSLATION_PREFIXES = {"rdfs:": RDFS, "skos:": SKOS, "owl:": OWL, "rdf:": RDF, "dc:": DC, "dcterms:": DCTERMS}

#: Annotations that a documentation page lists, by their names.
ANNOTATIONS = {
    "seeAlso": RDFS + "seeAlso", "isDefinedBy": RDFS + "isDefinedBy", "versionInfo": VERSION_INFO, "deprecated": DEPRECATED, "example": SKOS + "example", "note": SKOS + "note",
    "historyNote": SKOS + "historyNote", "editorialNote": SKOS + "editorialNote", "changeNote": SKOS + "changeNote", "scopeNote": SKOS + "scopeNote",
    "creator": DCTERMS + "creator", "created": DCTERMS + "created", "modified": DCTERMS + "modified", "source": DCTERMS + "source",
}

#: Names of the profiles, and what reasoning they allow.
PROFILE_TEXTS = {
    "rdf": ("RDF", "No schema; reasoning not applicable"),
    "rdfs": ("RDFS", "Subclass/subproperty inference available"),
    "owl_dl_simple": ("OWL 2 DL (simple)", "Standard DL reasoning; efficient"),
    "owl_dl_expressive": ("OWL 2 DL (expressive)", "Full DL reasoning; may be computationally expensive"),
    "owl_full": ("OWL 2 Full", "Undecidable; reasoning may not terminate"),
}

#: Terms that count as no individual in a description even where they are typed.
NO_INDIVIDUALS = [OWL_CLASS, OBJECT_PROPERTY, DATATYPE_PROPERTY, ANNOTATION_PROPERTY, RESTRICTION, ONTOLOGY, OWL + "AllDisjointClasses", OWL + "AllDifferent", NAMED_INDIVIDUAL, RDFS_CLASS, RDF_PROPERTY]

#: Folders of entity pages by kind.
FOLDERS = {"class": "classes", "object_property": "properties/object", "datatype_property": "properties/datatype", "annotation_property": "properties/annotation", "instance": "instances"}
