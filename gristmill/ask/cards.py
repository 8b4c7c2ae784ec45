"""Cards of tables: drafted from profiles or by a model, shared by tables of one schema, checked against each table's data."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import asdict, replace

from gristmill.ask.routing import checked_card
from gristmill.catalog import Card, Catalog, Table
from gristmill.functions.text import first_object
from gristmill.operators.profiling import key_uniqueness
from gristmill.plans.binder import Binder

DAY = re.compile(r"\b\d{1,2}[./-]\d{1,2}[./-]\d{4}\b|\b\d{4}-\d{2}-\d{2}\b")
ASKED = 'Describe the table as one JSON object: {"purpose": text, "entity_key": [columns], "validity": [start column, end column] or null, "measures": [columns], "caveats": [texts]}.'


def schema_hash(table: Table) -> str:
    """The same for tables of the same columns and types, in whatever order."""
    columns = sorted(f"{f.name}\0{f.dataType.simpleString()}" for f in table.df.schema if f.name in table.columns)
    return hashlib.sha1("\1".join(columns).encode()).hexdigest()


def drafted(table: Table, catalog: Catalog) -> Card:
    """What a table's profile alone shows: its measures, validity columns, and one column that is a key."""
    keys = [c for c, p in table.profile.items() if p.role == "identifier"]
    unique = {r["key"]: r["ratio"] or 0 for r in key_uniqueness(table.df, [[c] for c in keys]).collect()} if keys else {}
    best = max(keys, key=lambda c: unique[c], default=None)
    measures = [c for c, p in table.profile.items() if p.role == "measure"]
    return Card(entity_key=[best] if best else [], validity=Binder(catalog).validity(table), measures=measures)


def asked_card(table: Table, model: Callable[[list[dict]], str], schema: str) -> Card | None:
    """A card from a model's reply; None if that holds no object."""
    body = first_object(model([{"role": "system", "content": ASKED}, {"role": "user", "content": schema}]))
    if body is None:
        return None
    texts = lambda v: [str(x) for x in v] if isinstance(v, list) else []
    pair = texts(body.get("validity"))
    return Card(str(body.get("purpose") or ""), None, texts(body.get("entity_key")), (pair[0], pair[1]) if len(pair) == 2 else None, texts(body.get("measures")), texts(body.get("caveats")))


def localised(card: Card, day: str | None) -> Card:
    """A card for another table of the same schema: days in its words become that table's, or go."""
    said = lambda s: DAY.sub(day, s) if day else re.sub(r"\s*\(?\bas at\b[^,;)]*\)?", "", s, flags=re.I).strip() if DAY.search(s) else s
    return replace(card, purpose=said(card.purpose), caveats=[said(c) for c in card.caveats], as_of=day)


def build_cards(catalog: Catalog, describe: Callable[[list[str]], str], model: Callable[[list[dict]], str] | None = None) -> dict[str, Card]:
    """A card for every table whose schema has changed since it got one; one draft for all tables of
    a schema, made local to each and checked against its own data. Cards of unchanged tables stay."""
    drafts: dict[str, Card] = {}
    for table in catalog.tables.values():
        if table.card.schema and table.card.schema not in drafts:
            drafts[table.card.schema] = table.card
    made = {}
    for name, table in catalog.tables.items():
        code = schema_hash(table)
        if table.long_of is not None or table.card.schema == code:
            continue
        if code not in drafts:
            drafts[code] = (asked_card(table, model, describe([name])) if model else None) or drafted(table, catalog)
        card = checked_card(localised(drafts[code], table.card.as_of), table)
        table.card = made[name] = replace(card, schema=code)
    return made


def card_text(card: Card) -> str:
    return json.dumps({k: v for k, v in asdict(card).items() if v and k != "schema"}, ensure_ascii=False)
