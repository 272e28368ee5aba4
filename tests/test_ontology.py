"""A literal ontology with a diamond, a cycle and inherited properties."""

import json

from sitegrain import catalog
from sitegrain.operators import ontology

S = "http://schema.org/"
GRAPH = [
    {"@id": S + "Thing", "@type": "rdfs:Class"}, {"@id": S + "Place", "@type": ["rdfs:Class", "x"], "rdfs:subClassOf": {"@id": S + "Thing"}},
    {"@id": "https://schema.org/Organization", "@type": "rdfs:Class", "rdfs:subClassOf": [{"@id": S + "Thing"}]},
    {"@id": S + "LocalBusiness", "@type": "rdfs:Class", "rdfs:subClassOf": [{"@id": S + "Place"}, {"@id": S + "Organization"}]},
    {"@id": "x:A", "@type": "rdfs:Class", "rdfs:subClassOf": {"@id": "x:B"}}, {"@id": "x:B", "@type": "rdfs:Class", "rdfs:subClassOf": {"@id": "x:C"}}, {"@id": "x:C", "@type": "rdfs:Class", "rdfs:subClassOf": [{"@id": "x:A"}, {"@id": "x:A"}]},
    {"@id": S + "name", "@type": "rdf:Property", S + "domainIncludes": [{"@id": S + "Thing"}, {"@id": S + "Place"}]}, {"@id": S + "geo", "@type": ["rdf:Property"], "domainIncludes": {"@id": S + "Place"}},
    {"@id": "x:p", "@type": "rdf:Property", "domainIncludes": {"@id": "x:B"}}, {"@id": S + "none", "@type": "rdf:Property"}, {"@type": "rdfs:Class"}, {"@id": "x:other"},
]


def test_ontology(spark):
    found = ontology.entries(spark.createDataFrame([(json.dumps({"@graph": GRAPH}),), ("not json",), (None,), ('{"@graph": 3}',)], "json string"))
    short = lambda x: x.replace("https://schema.org/", "")
    above = ontology.closure(ontology.sub_classes(found))
    assert sorted((short(r.child), short(r.ancestor)) for r in above.collect()) == sorted([
        ("Place", "Thing"), ("Organization", "Thing"), ("LocalBusiness", "Place"), ("LocalBusiness", "Organization"), ("LocalBusiness", "Thing"), *((f"x:{a}", f"x:{b}") for a in "ABC" for b in "ABC"),
    ])
    got = sorted((short(r["class"]), short(r.property), r.n_origins) for r in ontology.inherited(above, ontology.properties(found)).collect())
    assert got == sorted([("Thing", "name", 1), ("Place", "name", 2), ("Place", "geo", 1), ("Organization", "name", 1), ("LocalBusiness", "name", 2), ("LocalBusiness", "geo", 1), *((f"x:{a}", "x:p", 1) for a in "ABC")])
    pairs = [("LocalBusiness", "Thing", True), ("Thing", "LocalBusiness", False), ("https://schema.org/Place", "Thing", True), ("Nowhere", "Nowhere", True), ("Nowhere", "Thing", False), ("x:A", "x:C", True)]
    out = ontology.under(spark.createDataFrame([p[:2] for p in pairs], "child string, parent string"), above).collect()
    assert {(r.child, r.parent, r.holds) for r in out} == set(pairs)


def test_nothing(spark):
    empty = spark.createDataFrame([("", "a"), (None, "b"), ("c", None)], "child string, parent string")
    assert ontology.closure(empty).count() == 0


def test_long_chain_and_repeats(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(40)] * 2
    assert ontology.closure(spark.createDataFrame(chain, "child string, parent string")).count() == 41 * 40 // 2


def test_inherited_along_a_diamond_and_a_cycle(spark):
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("d", "b"), ("a", "z"), ("z", "y"), ("y", "z"), ("", "a"), (None, "a"), ("e", None)]
    stated = [("a", "p"), ("a", "p"), ("b", "p"), ("c", "q"), ("y", "r"), ("z", "r"), ("alone", "s")]
    edges, stated = spark.createDataFrame(edges, "child string, parent string"), spark.createDataFrame(stated, "class string, property string")
    expected = {("a", "p", 1), ("b", "p", 2), ("c", "p", 1), ("d", "p", 2), ("c", "q", 1), ("d", "q", 1), ("alone", "s", 1), *((x, "r", 2) for x in "abcdyz")}
    got = [tuple(r) for r in ontology.inherited_along(edges, stated).collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert {tuple(r) for r in ontology.inherited(ontology.closure(edges), stated.distinct()).collect()} == expected


def test_inherited_makes_no_closure(spark, monkeypatch):
    """Parts with a diamond at each step have far more ancestors than the result needs."""
    monkeypatch.setattr(ontology, "closure", None)
    assert catalog.QUERIES["gra09_inherited_properties"](spark, "/root/testdata/sf0.001").count() > 0
