"""How rows become the text of an answer: one table of what each kind of row is called and how it reads."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Kind:
    """title of a list of such rows; row: how one reads, from its values by name; note: what is to be known of them; inline: whether they share a line."""

    title: str
    row: str
    note: str = ""
    inline: bool = False


KINDS = {
    # a sheet
    "skill": Kind("Skills", "{name} {level}+{bonus}", inline=True),
    "top_skill": Kind("Highest skills", "{name} {level}+{bonus}", inline=True),
    "currency": Kind("Currencies", "{name}: {amount}", inline=True),
    "active": Kind("Active quests", "{name}", inline=True),
    "completed": Kind("Completed quests", "{name}", inline=True),
    "favour": Kind("Persons who are not neutral", "{name} ({favor})", inline=True),
    "known": Kind("Learnt", "{shown}", inline=True),
    "unlisted": Kind("On the sheet, but not in the tables", "{internal_name}", inline=True),
    "other": Kind("Learnt, of no skill", "{internal_name}", inline=True),
    "missing": Kind("To be learnt, by level", "{level:g}: {shown} [{internal_name}]"),
    # a stall
    "value": Kind("Value in the tables", "{name}: {value:g}", "what a vendor pays at least, not a price that anyone asked for"),
    "recipe": Kind("Recipes of that name", "{name}: {value:g}"),
    "order": Kind("Work orders", "{needed:g} x {item} pays {payout} ({each} a piece){gain}: {quest} (quest {id})"),
    "source": Kind("Where it comes from", "{type}: {target}"),
    "sold": Kind("Sold, oldest first", "{event_at}: {quantity} x {item} for {price_unit:g} each, {total:g} in all, to {player}", "each is a sale of its own"),
    "asking": Kind("Asked for, oldest first", "{event_at}: {quantity} x {item} for {price_unit:g} each ({action})", "may not have been sold"),
    "seen": Kind("Seen at other stalls, newest first", "{observed_at}: {quantity} x {item_name}, {price}{where}"),
    "said": Kind("Said in chat, newest first", "{ts} {channel} {speaker}: {said}"),
    "listed": Kind("Listed now", "{item}: {quantity} in all, {tiers}"),
    "unpriced": Kind("Without a price", "{item}: {quantity} ({status})"),
}


@dataclass
class Answer:
    """Lists and single lines, in the order in which they are added."""

    lines: list[str] = field(default_factory=list)

    def say(self, text: str) -> Answer:
        self.lines.append(text)
        return self

    def show(self, kind: str, rows: Iterable[Any], total: int | None = None, none: str = "") -> Answer:
        """Rows of a kind under its title; total: how many there are if not all are shown; none: what stands there if there are none."""
        k, rows = KINDS[kind], [r if isinstance(r, dict) else r.asDict() for r in rows]
        if not rows:
            return self.say(f"{k.title}: {none}") if none else self
        n = len(rows) if total is None else total
        head = f"{k.title} ({n}{f', the first {len(rows)}' if n > len(rows) else ''})" + (f" - {k.note}" if k.note else "")
        shown = [k.row.format(**{c: "?" if v is None else v for c, v in r.items()}) for r in rows]
        self.lines += [f"{head}: {', '.join(shown)}"] if k.inline else [f"{head}:", *(f"- {x}" for x in shown)]
        return self

    def text(self) -> str:
        return "\n".join(self.lines)
