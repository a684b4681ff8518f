"""Structured data in pages as lines of text.

Each kind of thing has an ordered list of fields; a field gives no line, one or
several.  The first kind whose name is part of a node's type applies.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

Node = dict
Field = Callable[[Node], Iterator[str]]


def _text(value) -> str:
    """A value as a web script would write it in a string."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    if isinstance(value, list):
        return ",".join("" if v is None else _text(v) for v in value)
    if isinstance(value, dict):
        return "[object Object]"
    return str(value)


def _many(value) -> list:
    return value if isinstance(value, list) else [value] if value else []


def _plain(label: str, *names: str) -> Field:
    """The first of some properties that is there."""

    def field(node: Node) -> Iterator[str]:
        value = next((node[n] for n in names if node.get(n)), None)
        if value:
            yield f"{label}: {_text(value)}"

    return field


def _named(label: str, name: str) -> Field:
    """A string, or the name of an object."""

    def field(node: Node) -> Iterator[str]:
        value = node.get(name)
        value = value.get("name") if isinstance(value, dict) else value if isinstance(value, str) else None
        if value or isinstance(node.get(name), str) and label not in ("Author",):
            yield f"{label}: {_text(value if value is not None else '')}"

    return field


def _price(offer: Node) -> Iterator[str]:
    if offer.get("price") is not None:
        unit = f"{_text(offer['priceCurrency'])} " if offer.get("priceCurrency") else ""
        yield f"Price: {unit}{_text(offer['price'])}"


def _offers(full: bool) -> Field:
    def field(node: Node) -> Iterator[str]:
        for offer in _many(node.get("offers")):
            if not isinstance(offer, dict):
                continue
            yield from _price(offer)
            if not full:
                continue
            low, high, unit = offer.get("lowPrice"), offer.get("highPrice"), offer.get("priceCurrency")
            if low is not None and high is not None and unit:
                yield f"Price Range: {_text(unit)} {_text(low)} – {_text(unit)} {_text(high)}"
            if offer.get("availability"):
                yield f"Availability: {re.sub(r'.*/', '', _text(offer['availability']))}"
            if offer.get("priceValidUntil"):
                yield f"Price Valid Until: {_text(offer['priceValidUntil'])}"

    return field


def _rating(node: Node) -> Iterator[str]:
    r = node.get("aggregateRating")
    if isinstance(r, dict) and r.get("ratingValue"):
        best = f"/{_text(r['bestRating'])}" if r.get("bestRating") else ""
        yield f"Rating: {_text(r['ratingValue'])}{best} ({_text(r.get('reviewCount') or r.get('ratingCount') or '?')} reviews)"


def _properties(node: Node) -> Iterator[str]:
    for p in _many(node.get("additionalProperty")):
        if isinstance(p, dict) and p.get("name") and p.get("value") is not None:
            name, value = _text(p["name"]).strip(), _text(p["value"]).strip()
            if 0 < len(name) < 50 and 0 < len(value) < 150:
                yield f"{name}: {value}"


def _area(node: Node) -> Iterator[str]:
    area = node.get("areaServed")
    if area:
        yield f"Area Served: {area if isinstance(area, str) else json.dumps(area, ensure_ascii=False, separators=(',', ':'))}"


def _address(node: Node) -> Iterator[str]:
    a = node.get("address")
    if isinstance(a, dict):
        a = ", ".join(_text(a[k]) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry") if a.get(k))
    if a and isinstance(a, str):
        yield f"Address: {a}"


def _hours(node: Node) -> Iterator[str]:
    said = node.get("openingHours")
    if said:
        said = ", ".join(map(_text, said)) if isinstance(said, list) else _text(said)
    else:
        each = [s for s in _many(node.get("openingHoursSpecification")) if isinstance(s, dict)]
        days = lambda s: "-".join(map(_text, s["dayOfWeek"])) if isinstance(s.get("dayOfWeek"), list) else _text(s.get("dayOfWeek") or "")
        said = ", ".join(f"{days(s)}: {_text(s.get('opens') or '')}-{_text(s.get('closes') or '')}" for s in each)
    if said:
        yield f"Opening Hours: {said}"


def _answers(node: Node) -> Iterator[str]:
    for entry in _many(node.get("mainEntity")):
        if not isinstance(entry, dict):
            continue
        given = entry.get("acceptedAnswer")
        answer = (given.get("text") or given.get("name") or "") if isinstance(given, dict) else ""
        if isinstance(answer, str):
            answer = " ".join(re.sub(r"<[^>]+>", " ", answer).split())
        question = entry.get("name") or entry.get("question")
        if question and answer:
            yield f"Q: {_text(question)}\nA: {_text(answer)}"


#: names that a type contains, and the fields in order
KINDS: tuple[tuple[tuple[str, ...], tuple[Field, ...]], ...] = (
    (("product", "individualproduct", "someproduct"), (_plain("Product", "name"), _plain("Description", "description"), _plain("SKU", "sku"), _plain("MPN", "mpn"), _named("Brand", "brand"), _offers(True), _rating, _named("Material", "material"), lambda n: iter([f"Pattern: {n['pattern']}"] if isinstance(n.get("pattern"), str) else []), _properties)),
    (("service",), (_plain("Service", "name"), _plain("Description", "description"), _offers(False), _area, _plain("Service Type", "serviceType"))),
    (("localbusiness", "organization", "store", "restaurant", "hotel", "medicalbusiness", "business"), (_plain("Business Name", "name"), _plain("Phone", "telephone"), _plain("Email", "email"), _plain("Website", "url"), _address, _hours, _plain("Price Range", "priceRange"), _plain("Description", "description"))),
    (("faqpage",), (_answers,)),
    (("article", "blogposting", "newsarticle"), (_plain("Article", "headline", "name"), _plain("Description", "description"), _named("Author", "author"), _plain("Date Published", "datePublished"))),
)


def lines(scripts: list[list]) -> tuple[str, list[str]]:
    """The text of all structured data of a page, and the types met.  A script
    that isn't JSON is passed over; one that is null is an error."""
    out: list[str] = []
    types: dict[str, None] = {}
    for children in scripts:
        try:
            data = json.loads("".join(c for c in children if isinstance(c, str)))
        except ValueError:
            continue
        if data is None:
            raise TypeError("structured data is null")
        graph = data.get("@graph") if isinstance(data, dict) else None
        for node in graph if isinstance(graph, list) else data if isinstance(data, list) else [data]:
            if not isinstance(node, dict):
                continue
            own = [_text(t).lower() for t in _many(node.get("@type")) if t]
            types.update(dict.fromkeys(own))
            for names, fields in KINDS:
                if any(n in t for t in own for n in names):
                    out += [line for field in fields for line in field(node)]
                    break
    return "\n".join(out).strip(), list(types)
