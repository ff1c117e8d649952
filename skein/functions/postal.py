"""Authors' Addresses sections: lines by what they are, and blocks of lines as authors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Countries by name and abbreviation, regions that end the line of a city, words of firms and institutions,
# words of streets.
COUNTRIES = """
    afghanistan albania algeria andorra angola argentina armenia australia austria azerbaijan bahrain bangladesh belarus belgium bolivia
    botswana brazil brunei bulgaria cambodia cameroon canada chile china colombia croatia cuba cyprus czechia denmark ecuador egypt england
    estonia ethiopia finland france georgia germany ghana greece guatemala guernsey honduras hungary iceland india indonesia iran iraq ireland
    israel italy jamaica japan jordan kazakhstan kenya korea kuwait latvia lebanon liechtenstein lithuania luxembourg macao malaysia malta
    mauritius mexico moldova monaco mongolia montenegro morocco myanmar nepal netherlands nicaragua nigeria norway oman pakistan palestine
    panama paraguay peru philippines poland portugal qatar romania russia scotland senegal serbia singapore slovakia slovenia spain sweden
    switzerland syria taiwan tanzania thailand tunisia turkey turkiye uganda ukraine uruguay uzbekistan venezuela vietnam wales zambia zimbabwe
""".split()
COUNTRY_CODES = "ar at au be br ca ch cn cz de dk es fi fr gb gr hk hu ie il in it jp kr lu mx nl no nz pl pt ro ru se sg tr tw ua uk us usa".split()
COUNTRY_PHRASES = (
    "bosnia and herzegovina", "costa rica", "czech republic", "dominican republic", "el salvador", "hong kong", "new zealand", "north macedonia", "peoples republic of china", "pr china", "puerto rico",
    "republic of korea", "russian federation", "saudi arabia", "south africa", "south korea", "sri lanka", "the netherlands", "united arab emirates", "united kingdom", "united states", "united states of america",
)
REGIONS = """
    al ak az ar ca co ct de fl ga hi id il ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok pa ri sc sd tn tx ut vt va wa wi wy dc
    ab bc mb nb nl ns nt nu on pe qc sk yt nsw vic qld tas act
""".split()
FIRM_WORDS = """
    inc incorporated llc llp lp ltd limited gmbh ag ab as bv nv sa sas srl spa plc oy oyj kk pty co company corp corporation group holdings
    technologies technology systems labs laboratories university institute consulting foundation project
""".split()
UNIT_WORDS = "school department dept faculty college academy".split()
STREET_WORDS = """
    st street rd road ave avenue av blvd boulevard bd dr drive ln lane way pl place ct court cir circle sq square ter terrace pkwy parkway
    hwy highway close crescent walk row quay wharf strasse str allee weg platz chemin rue via viale corso calle carrera laan straat gatan
""".split()
# Fixed forms.
HEADING = re.compile(r"(?m)^Author(?:s'|'s)? Address(?:es)?[ \t]*$")
PAGE_LINE = re.compile(r"^\f|\[Page\s+\d+\]|Expires?\s+\w+\s+\d{4}")
EDITOR = re.compile(r"(?i)\s*\((?:editor|ed\.?)\)\s*$")
EMAIL = re.compile(r"(?i)^email:\s*(\S+@\S+)")
OTHER_LABEL = re.compile(r"^(?:Phone|URI|Fax|Tel):")
POSTCODE = re.compile(r"\b\d{4,6}(?:-\d{4})?\b|\b[A-Z]\d[A-Z]\s*\d[A-Z]\d\b|\b[A-Z]{1,2}\d[A-Z\d]?\s+\d[A-Z]{2}\b")
HOUSE = re.compile(r"^(?:\d+[/-]\d+|\d{2,}[A-Za-z]?|\d+)[\s,]")
BOX = re.compile(r"(?i)^(?:p\.?\s*o\.?\s*box|post\s+office\s+box)\b")

_PLACES = {*COUNTRIES, *COUNTRY_CODES, *COUNTRY_PHRASES}
_REGIONS, _FIRMS, _STREETS, _UNITS = set(REGIONS), set(FIRM_WORDS), set(STREET_WORDS), {*FIRM_WORDS, *UNIT_WORDS}


def _words(line: str, mark: str) -> list[str]:
    """Words in small letters, punctuation replaced by `mark`."""
    return re.sub(r"[^\w\s]+", mark, line.lower()).split()


def line_kind(line: str) -> str:
    """What a line of a block is: void, contact, debris, country, street, postcode, region, or else a name (of a person, firm or town).

    A name is what nothing speaks against, so a lone town is one: it can't be told from a firm by itself.
    """
    line = line.strip()
    spaced, joined = _words(line, " "), _words(line, "")
    plain, digits = line.split(), sum(c.isdigit() for c in line)
    if not spaced:
        return "void"
    if "@" in line or line.endswith(":") or re.match(r"(?i)https?://|www\.", line) or (digits >= 7 and re.fullmatch(r"[\d\s()+.\-]{7,}", line)):
        return "contact"
    if re.search(r",\s*\d{1,3}$", line) or (len(plain) > 1 and line.isascii() and line == line.lower()):
        return "debris"
    if " ".join(spaced) in _PLACES or " ".join(joined) in _PLACES:
        return "country"
    if BOX.match(line) or (HOUSE.match(line) and (len(plain) >= 3 or _STREETS & set(spaced))):
        return "street"
    if POSTCODE.search(line):
        return "postcode"
    bare = re.fullmatch(r"[A-Za-z]{2,3}[.,]?", plain[-1])
    return "region" if bare and 2 <= len(plain) <= 3 and spaced[-1] in _REGIONS and not _FIRMS & set(spaced) else "name"


def blocks(text: str) -> Iterator[tuple[int, list[str]]]:
    """Indent and lines of each block of the section, up to the first line that isn't indented; lines of pages are left out."""
    head = HEADING.search(text or "")
    rows = [x for x in text[head.end() :].splitlines()[1:] if not PAGE_LINE.search(x)] if head else []
    inside = rows[: next((k for k, x in enumerate(rows) if x[:1] not in ("", " ", "\t")), len(rows))]
    for void, run in groupby(inside, key=lambda x: not x.strip()):
        if not void:
            own = list(run)
            yield len(own[0]) - len(own[0].lstrip()), [x.strip() for x in own]


def author_addresses(text: str) -> list[dict]:
    """Authors in order: name, editor, organisation (null if the line after the name is one of an address), email, address (lines).

    A block that begins with a label, and blocks indented deeper than it, say more of the author before.
    """
    out, label = [], None
    for indent, lines in blocks(text):
        if label is not None and indent > label:
            continue
        label = indent if lines[0].endswith(":") else None
        mails = [m[1].rstrip(".,") for x in lines if (m := EMAIL.match(x))]
        rest = [x for x in lines if not EMAIL.match(x) and not OTHER_LABEL.match(x)]
        if label is None and rest:
            org = rest[1] if len(rest) > 1 and line_kind(rest[1]) == "name" else None
            out.append({"name": EDITOR.sub("", rest[0]), "editor": bool(EDITOR.search(rest[0])), "organisation": org, "email": mails[0] if mails else None, "address": rest[1 + (org is not None) :]})
    return out


def locality(line: str) -> str | None:
    """An address line in the form in which it can be compared with another document's organisation; null if it names an institution."""
    words = _words(line, " ")
    return " ".join(words) if words and not _UNITS & set(words) and line_kind(line) in ("name", "region") else None


ADDRESS = "array<struct<name: string, editor: boolean, organisation: string, email: string, address: array<string>>>"


def addresses(text: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(author_addresses, na_action="ignore")

    return F.pandas_udf(run, ADDRESS)(text)


def localities(lines: Column) -> Column:
    """The comparable forms of an array of lines."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [x for x in map(locality, v) if x], na_action="ignore")

    return F.pandas_udf(run, "array<string>")(lines)
