"""Parsers that turn pages and files of each source into an outline of passages.

Each is a plain function from text to ``Outline``; it raises ``SourceError`` when the structure is not the one expected.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

from .markup import Block, Node, Outline, SourceError, Tag, is_mark, read_html, squeeze

# --- EU legal acts ----------------------------------------------------------------------------------------

# Words that head a chapter, title, section or annex, and the kind and path segment of each.
_HEADS = {"KAPITEL": ("kapitel", "kap"), "CHAPTER": ("kapitel", "kap"), "TITEL": ("titel", "titel"), "TITLE": ("titel", "titel"), "TEIL": ("teil", "teil"), "PART": ("teil", "teil"), "ABSCHNITT": ("abschnitt", "abschnitt"), "SECTION": ("abschnitt", "abschnitt")}
_RANK = {"teil": 0, "titel": 1, "kapitel": 2, "abschnitt": 3}


def split_head(text: str) -> tuple[str, str] | None:
    """Kind and number of a heading such as KAPITEL II; null without a number or for another word."""
    words = text.split()
    return (_HEADS[words[0].upper()][0], words[1]) if len(words) >= 2 and words[0].upper() in _HEADS else None


def paragraph_mark(text: str) -> tuple[str | None, str]:
    """The number that opens a paragraph, as (1), (1a) or 1. and a blank, and the wording after it."""
    m = re.match(r"\((\d{1,3}[a-z]?)\)\s*|(\d{1,3})\.\s+", text)
    return (m[1] or m[2], text[m.end() :]) if m else (None, text)


def _rows_of(table: Tag) -> list[Tag]:
    return [r for r in _direct(table, "tr", through=("tbody", "thead", "tfoot"))]


def _direct(tag: Tag, name: str, through: tuple[str, ...]) -> list[Tag]:
    out = []
    for c in tag.tags():
        if c.name == name:
            out.append(c)
        elif c.name in through:
            out += _direct(c, name, through)
    return out


def _own_text(cell: Tag) -> str:
    """The wording of a cell without tables in it."""
    return squeeze(Tag("", {}, [c for c in cell.children if not (isinstance(c, Tag) and c.name == "table")])._raw())


def _table_blocks(table: Tag, depth: int) -> list[Block]:
    """A row of a mark and wording is a list item with what is nested below it; other rows are items of joined cells."""
    out = []
    rows = _rows_of(table)
    for row in rows:
        cells = row.tags("td", "th")
        if len(cells) == 2 and len(rows) == 1 or len(cells) == 2 and is_mark(cells[0].text()):
            out.append(Block(_own_text(cells[1]), cells[0].text(), depth))
            for nested in cells[1].tags("table"):
                out += _table_blocks(nested, depth + 1)
        else:
            out.append(Block(" | ".join(c.text() for c in cells), "", depth))
    return out


def _blocks(tag: Tag, skip: tuple[str, ...] = ()) -> list[Block]:
    out: list[Block] = []
    for c in tag.tags():
        if any(c.has(s) for s in skip):
            continue
        if c.name == "table":
            out += _table_blocks(c, 0)
        elif c.has("oj-enumeration-spacing"):
            marks = [p.text() for p in c.tags("p")]
            out.append(Block(squeeze(" ".join(marks[1:])), marks[0] if marks else "", 0))
        elif c.name in ("p", "li", "h1", "h2", "h3", "h4"):
            if text := c.text():
                out.append(Block(text))
        else:
            out += _blocks(c, skip)
    return out


def eu_act(page: str) -> Outline:
    """A legal act in the XHTML of the EU's publications: citations, recitals, chapters, sections, articles, annexes."""
    root, out = read_html(page), Outline()
    levels: list[tuple[int, Node]] = []
    groups: dict[str, Node] = {}
    heads: list[Node] = []
    annexes: list[tuple[Node, list[Node]]] = []

    def group(kind: str, path: str, title: str) -> Node:
        if path not in groups:
            groups[path] = out.add(Node(path, kind, title=title, path=path))
        return groups[path]

    def visit(tag: Tag) -> None:
        for c in tag.tags():
            key = c.attrs.get("id", "")
            if m := re.fullmatch(r"(cit|rct)_(\w+)", key):
                kind, path, title = ("bezug", "bezug", "Bezugsvermerke") if m[1] == "cit" else ("erwaegungsgrund", "eg", "Erwägungsgründe")
                blocks = _blocks(c)
                if blocks:
                    blocks[0].text = paragraph_mark(blocks[0].text)[1]
                    out.add(Node(key, kind, m[2], path=f"{path}/{m[2]}", parent=group("abschnitt", path, title), blocks=blocks))
            elif m := re.fullmatch(r"art_(\w+)", key):
                article(c, key, m[1])
            elif m := re.fullmatch(r"anx_(\w+)", key):
                annex(c, key, m[1])
            elif c.name == "p" and c.has("oj-ti-section-1") and (head := split_head(c.text())):
                kind, number = head
                while levels and levels[-1][0] >= _RANK[kind]:
                    levels.pop()
                above = levels[-1][1] if levels else None
                segment = next(s for k, s in _HEADS.values() if k == kind)
                path = f"{above.path}/{segment}/{number}" if above else f"{segment}/{number}"
                levels.append((_RANK[kind], out.add(Node(path.replace("/", "_"), kind, number, path=path, parent=above))))
                heads.append(levels[-1][1])
            elif c.name == "p" and c.has("oj-ti-section-2"):
                if heads and heads[-1].title is None:
                    heads[-1].title = c.text()
            else:
                visit(c)

    def article(tag: Tag, key: str, number: str) -> None:
        title = next((t.text() for t in tag.walk() if t.has("oj-sti-art")), None)
        node = out.add(Node(key, "artikel", number, title=title, path=f"art/{number}", parent=levels[-1][1] if levels else None))
        numbered = [c for c in tag.tags("div") if re.fullmatch(r"\d{3}\.\d{3}[a-z]?", c.attrs.get("id", ""))]
        for k, part in enumerate(numbered, 1):
            blocks = _blocks(part)
            mark = None
            if blocks and blocks[0].mark is None:
                mark, blocks[0].text = paragraph_mark(blocks[0].text)
            mark = mark or str(k)
            out.add(Node(part.attrs["id"], "absatz", mark, path=f"art/{number}/abs/{mark}", parent=node, blocks=blocks))
        if not numbered:
            node.blocks = _blocks(tag, skip=("eli-title", "oj-ti-art", "oj-sti-art"))

    def annex(tag: Tag, key: str, number: str) -> None:
        titles = [t.text() for t in tag.tags("p") if t.has("oj-doc-ti")]
        annexes.append((Node(key, "anhang", number, title=titles[1] if len(titles) > 1 else None, path=f"anh/{number}", blocks=_blocks(tag, skip=("oj-doc-ti",))), []))

    visit(root)
    for node, _ in annexes:
        out.add(node)
    return out.require(1)


# --- German statutes --------------------------------------------------------------------------------------

_UNITS = {"buch": "teil", "teil": "teil", "kapitel": "kapitel", "abschnitt": "abschnitt", "unterabschnitt": "abschnitt", "titel": "abschnitt"}


def _element_text(e: ET.Element, without: tuple[str, ...] = ()) -> str:
    parts = [e.text or ""]
    for c in e:
        if c.tag not in without:
            parts.append((" " if c.tag in ("P", "BR", "LA", "DD", "DT") else "") + _element_text(c, without))
        parts.append(c.tail or "")
    return squeeze("".join(parts))


def _definition_items(dl: ET.Element, depth: int) -> list[Block]:
    out, mark = [], ""
    for c in dl:
        if c.tag == "DT":
            mark = _element_text(c)
        elif c.tag == "DD":
            out.append(Block(_element_text(c, without=("DL",)), mark, depth))
            for inner in c.iter("DL"):
                out += _definition_items(inner, depth + 1)
                break
    return out


def statute(xml: str, only: list[str] | None = None) -> Outline:
    """A German statute in the XML of the federal portal; ``only``: numbers of the sections to take, all if not given."""
    try:
        root = ET.fromstring(xml.strip())
    except ET.ParseError as e:
        raise SourceError(f"no XML: {e}") from e
    out, levels = Outline(), []
    for norm in root.iter("norm"):
        meta = norm.find("metadaten")
        if meta is None:
            continue
        out.title = out.title or meta.findtext("jurabk")
        unit = meta.find("gliederungseinheit")
        if unit is not None:
            code = (unit.findtext("gliederungskennzahl") or "").strip()
            while levels and not (len(code) > len(levels[-1][0]) and code.startswith(levels[-1][0])):
                levels.pop()
            label = squeeze(unit.findtext("gliederungsbez") or "")
            kind = next((k for w in reversed(label.lower().split()) if (k := _UNITS.get(w))), "abschnitt")
            node = Node(f"gl_{code}", kind, label=label or None, title=squeeze(unit.findtext("gliederungstitel") or "") or None, path=f"gl/{code}", parent=levels[-1][1] if levels else None)
            levels.append((code, out.add(node)))
        m = re.match(r"(§|Anlage|Anhang)\s*(\d{1,4}[a-z]?)", squeeze(meta.findtext("enbez") or ""))
        if not m or only and m[2] not in only:
            continue
        section = m[1] == "§"
        base = f"{'par' if section else 'anh'}/{m[2]}"
        node = out.add(Node(base.replace("/", "_"), "paragraf" if section else "anhang", m[2], label=f"{m[1]} {m[2]}", title=squeeze(meta.findtext("titel") or "") or None, path=base, parent=levels[-1][1] if levels else None))
        at = node
        for p in norm.iter("P"):
            mark, text = re.match(r"\((\d{1,3}[a-z]?)\)\s*", w := _element_text(p, without=("DL",))), w
            if mark:
                text = w[mark.end() :]
                at = out.add(Node(f"{node.id}.{mark[1]}", "absatz", mark[1], path=f"{base}/abs/{mark[1]}", parent=node))
            if text:
                at.blocks.append(Block(text))
            for dl in p.findall("DL"):
                at.blocks += _definition_items(dl, 0)
    out.keep_with_text()
    return out.require(1)


# --- circulars and questions ------------------------------------------------------------------------------


def margin_number(text: str) -> tuple[str, str] | None:
    """A margin number of one to four digits and the wording after it; amounts and outline numbers are none."""
    m = re.match(r"(\d{1,4})\s+(?=\S)", text)
    return (m[1], text[m.end() :]) if m and not re.match(r"[.,%)]", text[m.end() :]) else None


def _page_head(root: Tag, out: Outline) -> None:
    h1 = root.first("h1")
    out.title = h1.text() if h1 else None
    m = re.search(r"\b(\d{2})\.(\d{2})\.(\d{4})\b", root.text())
    out.date = f"{m[3]}-{m[2]}-{m[1]}T00:00:00Z" if m else None


def _content(page: str) -> tuple[Tag, Outline, list[Tag]]:
    root, out = read_html(page), Outline()
    body = next((t for t in root.walk() if t.has("l-article__content")), None)
    if body is None:
        raise SourceError("no content found on the page")
    _page_head(root, out)
    lines: list[Tag] = []

    def flat(tag: Tag) -> None:
        for c in tag.tags():
            if c.name in ("h2", "h3", "h4", "p", "li"):
                lines.append(c)
            else:
                flat(c)

    flat(body)
    return root, out, lines


def _item(text: str) -> Block | None:
    m = re.match(r"([a-z0-9]{1,3}\))\s+", text)
    return Block(text[m.end() :], m[1]) if m else None


def circular(page: str) -> Outline:
    """A supervisory circular: numbered headings and passages with margin numbers; what follows a passage belongs to it."""
    _, out, lines = _content(page)
    levels: list[tuple[int, Node]] = []
    at: Node | None = None
    for line in lines:
        text = line.text()
        if line.name in ("h2", "h3", "h4"):
            depth = int(line.name[1])
            while levels and levels[-1][0] >= depth:
                levels.pop()
            m = re.match(r"(\d{1,3}(?:\.\d{1,3})*)\.?\s+(?=\S)", text)
            number, title = (m[1], text[m.end() :]) if m else (None, text)
            path = f"nr/{number}" if number else None
            levels.append((depth, out.add(Node(f"nr_{number or len(out.nodes)}", "kapitel" if depth == 2 else "abschnitt", number, title=title, path=path, parent=levels[-1][1] if levels else None))))
            at = None
        elif margin := margin_number(text):
            at = out.add(Node(f"rz_{margin[0]}", "absatz", margin[0], label=f"Rz. {margin[0]}", path=f"rz/{margin[0]}", parent=levels[-1][1] if levels else None, blocks=[Block(margin[1])]))
        elif at is not None and text:
            at.blocks.append(_item(text) or (Block(text, "") if line.name == "li" else Block(text)))
    return out.require(5)


def questions(page: str) -> Outline:
    """Questions and answers: the opener of an accordion is the question, what follows is its answer; unanswered ones are dropped."""
    _, out, lines = _content(page)
    group, at, n, g = None, None, 0, 0
    for line in lines:
        text = line.text()
        if line.name == "h2":
            g, at = g + 1, None
            group = out.add(Node(f"gr_{g}", "gruppe", str(g), title=text, path=f"gr/{g}"))
        elif line.has("c-richtext-accordion__opener"):
            n += 1
            at = out.add(Node(f"frage_{n}", "frage", str(n), label=f"Frage {n}", title=text, path=f"frage/{n}", parent=group))
        elif at is not None and text:
            at.blocks.append(_item(text) or (Block(text, "") if line.name == "li" else Block(text)))
    out.keep_with_text()
    return out.require(5)


# --- control catalogs -------------------------------------------------------------------------------------


def control_label(href: str) -> str:
    """The label a reference names: #ac-2.1 is AC-2(1)."""
    name, dot, number = href.lstrip("#").upper().partition(".")
    return f"{name}({number})" if dot else name


# Fixed value: how a control's wording refers to a parameter.
_PARAM = re.compile(r"\{\{\s*insert:\s*param,\s*([^\s}]+)\s*\}\}")


def catalog(text: str) -> Outline:
    """A control catalog in OSCAL JSON: families, controls, enhancements; statements, guidance and related controls only."""
    try:
        root = json.loads(text)["catalog"]
    except (ValueError, KeyError, TypeError) as e:
        raise SourceError("no catalog") from e
    out, params = Outline(), {}
    meta = root.get("metadata", {})
    out.title, modified = meta.get("title"), meta.get("last-modified", "")
    out.date = modified[:19] + "Z" if len(modified) >= 19 else None

    def collect(part: dict) -> None:
        for p in part.get("params", []):
            params[p["id"]] = p
        for c in [*part.get("groups", []), *part.get("controls", [])]:
            collect(c)

    def name_of(key: str) -> str:
        return params.get(key, {}).get("label") or "…"

    def value(key: str) -> str:
        """How a parameter is shown: assigned by its label, else a choice, whose own parameters show their labels; […] if nothing is known of it."""
        p = params.get(key, {})
        if isinstance(p.get("label"), str):
            return f"[Zuweisung: {p['label']}]"
        if "select" not in p:
            return "[…]"
        several = ", eine oder mehrere" if p["select"].get("how-many") == "one-or-more" else ""
        choices = [_PARAM.sub(lambda m: name_of(m[1]), c) for c in p["select"].get("choice", [])]
        return f"[Auswahl{several}: {' | '.join(choices)}]"

    def filled(prose: str) -> str:
        return " ".join(re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", _PARAM.sub(lambda m: value(m[1]), prose)).split())

    def mark(part: dict) -> str:
        return next((p.get("value", "") for p in part.get("props", []) if p.get("name") == "label" and "class" not in p), "")

    def items(part: dict, depth: int) -> list[Block]:
        blocks = []
        for p in (p for p in part.get("parts", []) if p.get("name") == "item"):
            blocks.append(Block(filled(p.get("prose", "")), mark(p), depth))
            blocks += items(p, depth + 1)
        return blocks

    def control(c: dict, above: Node) -> None:
        node = out.add(Node(c["id"], "control", mark(c), mark(c), c.get("title"), f"c/{c['id']}", above))
        for part in c.get("parts", []):
            if part.get("name") == "statement":
                node.blocks += ([Block(filled(part["prose"]))] if part.get("prose") else []) + items(part, 0)
            elif part.get("name") == "guidance" and part.get("prose"):
                node.blocks.append(Block("Discussion: " + filled(part["prose"])))
        links = c.get("links", [])
        if any(p.get("name") == "status" and p.get("value") == "withdrawn" for p in c.get("props", [])):
            to = ", ".join(control_label(x["href"]) for x in links if x.get("rel") in ("incorporated-into", "moved-to"))
            node.blocks.insert(0, Block("Withdrawn" + (f" – incorporated into or moved to: {to}" if to else "")))
        if related := [control_label(x["href"]) for x in links if x.get("rel") == "related"]:
            node.blocks.append(Block("Related controls: " + ", ".join(related)))
        for inner in c.get("controls", []):
            control(inner, node)

    collect(root)
    for g in root.get("groups", []):
        if not g.get("id"):
            continue
        family = out.add(Node(f"fam_{g['id']}", "teil", g["id"].upper(), g["id"].upper(), g.get("title"), f"fam/{g['id']}"))
        for c in g.get("controls", []):
            control(c, family)
    return out.require(100)


# --- own summaries ----------------------------------------------------------------------------------------


def summary(text: str) -> Outline:
    """An editorial summary in JSON: groups and entries of purpose, requirements, evidence and references."""
    try:
        root = json.loads(text)
        entries, groups = root["eintraege"], root.get("gruppen", [])
    except (ValueError, KeyError, TypeError) as e:
        raise SourceError("no summary") from e
    key = lambda s: re.sub("[^A-Za-z0-9]", "_", s).lower()
    out = Outline()
    out.title, out.date = root.get("regelwerk"), root.get("stand")
    known = {g["kennung"]: Node(f"g_{key(g['kennung'])}", "abschnitt", g["kennung"], g["kennung"], g.get("titel"), f"gr/{key(g['kennung'])}") for g in groups}
    by_group: dict[str | None, list[dict]] = {}
    for e in entries:
        by_group.setdefault(e.get("gruppe") if e.get("gruppe") in known else None, []).append(e)
    for name in [*known, None]:
        if name in by_group and name is not None:
            out.add(known[name])
        for e in by_group.get(name, []):
            blocks = [Block(e.get("zweck", ""))]
            if e.get("anforderungen"):
                blocks += [Block("Kernanforderungen:"), *(Block(t, f"{k}.") for k, t in enumerate(e["anforderungen"], 1))]
            if e.get("nachweise"):
                blocks.append(Block(f"Typische Nachweise: {', '.join(e['nachweise'])}."))
            if e.get("bezuege"):
                blocks.append(Block(f"Bezüge: {' '.join(e['bezuege'])}"))
            out.add(Node(f"z_{key(e['kennung'])}", "control", e["kennung"], e["kennung"], e.get("titel"), e.get("pfad"), known.get(name), blocks))
    return out.require(3)


# --- feeds ------------------------------------------------------------------------------------------------


# Named entities that feeds use beyond those of XML, and their characters; other names become blanks.
ENTITIES = {"nbsp": " ", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "euro": "€", "ndash": "–", "mdash": "–", "bdquo": "„", "ldquo": "“", "rdquo": "“", "quo": "“"}
# The entities of XML, in the order in which they are resolved in cleaned text.
XML_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def named_entities(text: str) -> str:
    """Named entities as characters; those of XML and numeric ones stay."""
    return re.sub(r"&([a-zA-Z][a-zA-Z0-9]{1,10});", lambda m: m[0] if m[1] in XML_ENTITIES else ENTITIES.get(m[1], " "), text)


def clean_text(text: str) -> str:
    """Feed text without tags, entities resolved, blanks squeezed; what stood between the tags stays, also that of scripts."""
    out = named_entities(re.sub(r"<[^>]*>", " ", text))
    for name, char in XML_ENTITIES.items():
        out = out.replace(f"&{name};", char)
    return " ".join(out.split())


def is_web_address(url: str) -> bool:
    """An http or https address of more than ten bytes."""
    plain = url.strip().lower()
    return plain.startswith(("http://", "https://")) and len(plain.encode()) > 10


def feed(xml: str) -> list[dict]:
    """Entries of an RSS 2.0 or Atom feed: titel, url, datum, text; title and text cleaned. Entries without title or web address are dropped.

    Of each field the first element of a name counts, with the wording before its first child. The address is the link's wording, else
    its href, else the guid; the date that of publishing (RSS), updating, publishing (Atom); the text the description, else the
    summary, else the content.
    """
    try:
        root = ET.fromstring(named_entities(xml).strip())
    except ET.ParseError as e:
        raise SourceError(f"no feed: {e}") from e
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    out = []
    for entry in (e for e in root.iter() if local(e) in ("item", "entry")):
        first: dict[str, ET.Element] = {}
        for c in entry:
            first.setdefault(local(c), c)
        said = {name: text for name, e in first.items() if (text := (e.text or "").strip())}
        any_of = lambda *names: next((said[n] for n in names if n in said), None)
        url = any_of("link") or ("link" in first and first["link"].get("href")) or any_of("guid") or ""
        if "title" in said and is_web_address(url):
            out.append({"titel": clean_text(said["title"]), "url": url, "datum": any_of("pubDate", "updated", "published"), "text": clean_text(any_of("description", "summary", "content") or "")})
    return out


PARSERS = {"eu": eu_act, "gesetz": statute, "rundschreiben": circular, "faq": questions, "oscal": catalog, "zusammenfassung": summary}
