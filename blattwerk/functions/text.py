"""Text functions as column expressions: tokens and stems, cleaning, shortening, addresses, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are not indexed, German and English, tested in folded spelling.
STOP_WORDS = """
der die das des dem den ein eine einer eines einem einen und oder aber auch als am an auf aus bei bis durch für fur gegen
im in ist sind mit nach nicht von vor zu zum zur über uber unter sowie dass dieser diese dieses werden wird kann können
konnen muss müssen mussen soll sollen haben hat ihre ihrer ihren ihr sich sie es er wenn wie so einschließlich
the and or of to in for on with by as at from that this these those be is are was were shall may which such any all their
its not other where when
""".split()

# Letters that are folded, and what they become.
FOLDED = ("äöüáàâéèêíìóòôúùûç", "aouaaaeeeiiooouuuc")
# Endings that are cut, longest first where one ends another.
ENDINGS = "ern est end ing em er en es et ed e s n".split()
#: Splits a text into words.
NON_WORD = r"[^\p{L}\p{N}]+"


def fold(word: Column) -> Column:
    """Lower case without accents and umlauts, ß as ss."""
    return F.replace(F.translate(F.lower(word), *FOLDED), F.lit("ß"), F.lit("ss"))


def is_stopped(word: Column) -> Column:
    """Whether a folded word is too short or too common for an index."""
    return (F.length(word) < 2) | word.isin(*STOP_WORDS)


def shorten_word(word: Column) -> Column:
    """The stem of a folded word; numbers stay as they are."""
    ending = "^(.{4,}?)(" + "|".join(ENDINGS) + ")$"
    noun = F.regexp_replace(word, "^(.{3,})ung(?:en)?$", "$1")
    cut = F.regexp_replace(F.regexp_replace(noun, ending, "$1"), ending, "$1")
    single = F.regexp_replace(cut, r"^(.{3,})([nmtlrsfp])\2$", "$1$2")
    plural = word.rlike("^.{3,}ies$")
    return F.when(word.rlike("^[0-9]+$"), word).when(plural, F.regexp_replace(word, "ies$", "y")).otherwise(single)


def stem(word: Column) -> Column:
    """The search stem of a word, or null if it is not indexed. Null gives null."""
    folded = fold(word)
    short = shorten_word(folded)
    return F.when(~is_stopped(folded) & ~is_stopped(short), short)


def words(text: Column) -> Column:
    """The words of a text in order, with repetitions; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NON_WORD), "")


def teaser(text: Column, most: int = 220) -> Column:
    """The first ``most`` characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def shorten_at_word(text: Column, most: int) -> Column:
    """Cut at the last blank up to position ``most`` (not the first character), else at ``most``, with an ellipsis."""
    head = F.regexp_extract(text, f"(?s)^(.{{1,{most}}}) ", 1)
    cut = F.when(F.length(head) > 0, head).otherwise(F.substring(text, 1, most))
    return F.when(F.length(text) > most, F.concat(cut, F.lit("…"))).otherwise(text)


def squeeze(text: Column) -> Column:
    """Every run of blanks of any kind as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\p{Z}\s\x0B\x{85}]+", " "))


# Named entities and their characters; the five of XML are resolved last, in this order.
ENTITIES = {"nbsp": " ", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "euro": "€", "ndash": "–", "mdash": "–", "bdquo": "„", "ldquo": "“", "rdquo": "“", "quo": "“"}
XML_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def clean_html(text: Column) -> Column:
    """Text without tags, with entities resolved, blanks squeezed. Numeric entities stay; unknown names become blanks."""
    out = F.regexp_replace(text, "<[^>]*>", " ")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    keep = "|".join(XML_ENTITIES)
    out = F.regexp_replace(out, f"&(?!(?:{keep});)[a-zA-Z][a-zA-Z0-9]{{1,10}};", " ")
    for name, char in XML_ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return squeeze(out)


def is_web_address(url: Column) -> Column:
    """Whether a value is an http or https address of more than ten bytes."""
    plain = F.lower(F.trim(url))
    return F.coalesce(plain.rlike("^https?://") & (F.octet_length(plain) > 10), F.lit(False))


def canonical_url(url: Column) -> Column:
    """An address without fragment, tracking parameters and slashes at the end of its path; the order of parameters stays."""
    plain = F.substring_index(url, "#", 1)
    path = F.regexp_replace(F.substring_index(plain, "?", 1), "/+$", "")
    query = F.when(plain.contains("?"), F.regexp_replace(plain, r"^[^?]*\?", "")).otherwise(F.lit(""))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.lower(F.substring_index(p, "=", 1)).rlike("^(utm_.*|nn|fbclid|gclid|)$")), "&")
    return F.concat(path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def url_id(url: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the canonical address in lower case."""
    return F.substring(F.sha2(F.lower(canonical_url(url)), 256), 1, 16)


def host_of(url: Column) -> Column:
    """The host of an address in lower case; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def url_allowed(url: Column, hosts: list[str]) -> Column:
    """Whether an address may be fetched: https on the usual port, no credentials, no bare IP, host on the list or below it."""
    host = host_of(url)
    authority = F.regexp_extract(url, r"^(?i:https)://([^/?#]*)", 1)
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    listed = F.lit(False)
    for h in hosts:
        listed = listed | (host == h.lower()) | F.endswith(host, F.lit("." + h.lower()))
    bare_ip = host.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*)$")
    return F.coalesce((authority != "") & ~authority.contains("@") & port.isin("", "443") & ~bare_ip & listed, F.lit(False))


def percent_encode(text: Column) -> Column:
    """RFC 3986 percent-encoding: unreserved characters stay."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def slug(text: Column) -> Column:
    """A key: lower case, everything but ASCII letters and digits as underscore."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", "_"))


def quoted(word: str) -> str:
    """A word as a literal part of a pattern."""
    import re

    return re.sub(r"([^\w\s])", r"\\\1", word)


def starts_a_word(text: Column, word: str) -> Column:
    """Whether ``word`` occurs at the start of a word; the end need not be one."""
    return text.rlike(r"(?<![\p{L}\p{N}])" + quoted(word))


def is_acronym(word: str) -> bool:
    """A word of at most five capitals, digits, hyphens and slashes with at least one capital: sought as written."""
    return len(word.encode()) <= 5 and any("A" <= c <= "Z" for c in word) and all("A" <= c <= "Z" or c.isdigit() and c.isascii() or c in "-/" for c in word)


# Kinds of outline nodes in German and English.
KIND_WORDS = {
    "artikel": ("Artikel", "Article"), "paragraf": ("§", "Section"), "absatz": ("Absatz", "Paragraph"), "anhang": ("Anhang", "Annex"),
    "kapitel": ("Kapitel", "Chapter"), "abschnitt": ("Abschnitt", "Section"), "control": ("Control", "Control"),
    "erwaegungsgrund": ("Erwägungsgrund", "Recital"), "teil": ("Teil", "Part"), "gruppe": ("Gruppe", "Group"),
}


def kind_word(kind: Column, lang: str = "de") -> Column:
    """The word for a kind of node; an unknown kind is its own word."""
    pairs = [F.lit(x) for k, (de, en) in KIND_WORDS.items() for x in (k, en if lang == "en" else de)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), kind)


def act_number(celex: Column) -> Column:
    """Year and number of a legal act from its CELEX key, as 2022/2554; null for other keys."""
    found = celex.rlike(r"^3\d{4}[RLD]\d{4}$")
    return F.when(found, F.concat_ws("/", F.substring(celex, 2, 4), F.substring(celex, 7, 4).cast("int").cast("string")))


def dotted_number(heading: Column) -> Column:
    """The outline number at the start of a heading such as "9.1.2 Title"; empty if there is none."""
    return F.regexp_extract(heading, r"^(\d{1,3}(?:\.\d{1,3})*)\.?\s+\S", 1)


def paragraph_mark(text: Column) -> Column:
    """The mark that opens a paragraph, (1) or (1a), without brackets; empty if there is none."""
    return F.regexp_extract(text, r"^\s*\((\d{1,3}[a-z]?)\)", 1)


def german_date(day: Column) -> Column:
    """A day as dd.mm.yyyy."""
    return F.date_format(day, "dd.MM.yyyy")
