"""Blocks of addresses and the kinds of their lines."""

import pytest
from pyspark.sql import functions as F

from skein.functions import postal
from skein.operators import people


def section(*blocks, heading="Authors' Addresses"):
    return "\n".join(["Some text", "", heading, "", *("\n".join(f"   {x}" for x in b) + "\n" for b in blocks)])


JANE, BOB = ["Jane Doe", "Example Firm", "Email: jane@example.org"], ["Bob Roe (editor)", "Other", "Phone: 1", "Email: bob@example.com,", "Email: second@example.com"]


def fields(text, *names):
    return [tuple(a[n] for n in names) for a in postal.author_addresses(text)]


def test_blocks():
    assert fields(section(JANE, BOB), "name", "organisation", "email", "editor") == [("Jane Doe", "Example Firm", "jane@example.org", False), ("Bob Roe", "Other", "bob@example.com", True)]
    assert fields(section(["Jane Doe", "Email: j@x.org"], heading="Author's Address"), "name", "organisation") == [("Jane Doe", None)]
    assert fields(section(["Ann Poe (ed.)", "Somewhere"], heading="Author Address  "), "name", "organisation", "email", "editor") == [("Ann Poe", "Somewhere", None, True)]
    assert postal.author_addresses("no such section\n   Jane\n") == [] == postal.author_addresses("") == postal.author_addresses(None)
    assert fields(section(["Jane Doe", "Firm", "Prahran VIC", "Australia", "URI:   https://x.org", "Email: j@x.org"]), "organisation", "address") == [("Firm", ["Prahran VIC", "Australia"])]


def test_a_town_in_the_organisations_place():
    assert fields(section(["Jane Doe", "Burlingame, CA  94010", "United States of America", "Email: j@x.org"]), "organisation", "address") == [(None, ["Burlingame, CA  94010", "United States of America"])]
    assert fields(section(["Jane Doe", "Prahran", "Australia"]), "organisation", "address") == [("Prahran", ["Australia"])]
    assert fields(section(["A B", "6011 W Courtyard Dr.", "Austin, TX 78730"], ["C D", "made in", "Email: c@x.org"]), "organisation") == [(None,), (None,)]


def test_pages_labels_and_the_end():
    footer = ["", "Doe & Roe      Expires 30 October 2026        [Page 13]", "", "\f", ""]
    text = section(JANE) + "\n".join(footer) + "\n   Bob Roe\n   Other\n\nNext Section\n\n   Not An Author\n"
    assert fields(text, "name") == [("Jane Doe",), ("Bob Roe",)]
    more = section(JANE) + "\n   Additional contact information:\n\n      奥 一穂\n      Example Firm\n\n\n   Bob Roe\n   Other\n"
    assert fields(more, "name") == [("Jane Doe",), ("Bob Roe",)]


@pytest.mark.parametrize(("kind", "lines"), [
    ("void", ["", "  ", "--", "..."]), ("contact", ["a@b.c", "Phone numbers:", "www.x.org", "https://x.org/y", "+1 (650) 555-0100"]), ("debris", ["true, 1", "made in", "somewhere or other"]),
    ("country", ["Australia", "P.R. China", "U.S.A", "FINLAND", "The Netherlands", "UK", "Republic of Korea"]), ("street", ["17/4 Krylatskaya st", "499 Park Avenue North", "P.O. Box 12", "10 Downing St", "Post Office Box 9"]),
    ("postcode", ["Burlingame, CA  94010", "Reston, VA 20190-1234", "Ottawa K1A 0B1", "London SW1A 1AA"]), ("region", ["Prahran VIC", "Reston, VA", "Palo Alto, CA."]),
    ("name", ["Prahran", "128 Technology", "802 Secure", "Thales Alenia Space (TAS)", "Foo Labs CA", "independent", "deSEC", "Example Firm", "4K Associates", "Département d'informatique"]),
])
def test_kinds(kind, lines):
    assert {x: postal.line_kind(x) for x in lines} == dict.fromkeys(lines, kind)


def test_on_columns_and_towns_that_another_document_shows(spark):
    rows = [("p", "d1", section(["Jane Doe", "Prahran", "Australia"])), ("p", "d2", section(["Jane Doe", "Firm", "Prahran", "Australia"])), ("q", "d3", section(["Bob", "Prahran"])), ("r", "d4", None), ("s", "d5", section(["Eve", "Acme", "Acme", "UK"]))]
    df = spark.createDataFrame(rows, "person string, doc string, text string").select("person", "doc", F.explode(postal.addresses(F.col("text"))).alias("a")).select("person", "doc", "a.*")
    assert {tuple(r) for r in people.employers(df).collect()} == {("p", "Firm", "d2"), ("q", "Prahran", "d3"), ("s", "Acme", "d5")}
