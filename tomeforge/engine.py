"""The tools by name: each takes plain arguments and gives a text; what goes wrong is a text too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeforge.functions.text import grouped_number, name_like
from tomeforge.functions.wiki import plain
from tomeforge.operators import guard, ledger, player, reports, search
from tomeforge.operators.answers import Answer

#: Characters of a page, and of a whole answer: its head and its tail.
PAGE, ANSWER, HEAD, TAIL = 20_000, 12_000, 8_000, 4_000
TOOLS = ("sql_query", "find_entities", "get_page", "corpus_search", "corpus_get_doc", "player_state")
#: Skills in a summary, names in a list, and prices asked for, at most.
TOP, MOST_NAMED, MOST_ASKED = 10, 60, 40
SECTIONS = ("summary", "skills", "currencies", "quests", "favor", "items", "stall", "stall_inventory", "abilities")


def _needs(args: dict, tool: str, name: str) -> str:
    value = str(args.get(name) or "").strip()
    if not value:
        raise player.Ask(f"{tool} error: missing required argument '{name}'.")
    return value


def capped(text: str, most: int = ANSWER, head: int = HEAD, tail: int = TAIL) -> str:
    """The head and the tail of a long answer, cut between lines where there are any, and how much is left out."""
    if len(text) <= most:
        return text
    a, b = text[:head], text[-tail:]
    a = a[: a.rfind("\n")] if "\n" in a else a
    b = b[b.find("\n") + 1 :] if "\n" in b else b
    return f"{a}\n…[{len(text) - len(a) - len(b)} characters left out]\n{b}"


class Engine:
    """tables: whichever of wiki_pages, documents, char_reports, player_items, stall_events, stall_inventory_baseline,
    stall_price_observations, chat_events, abilities, items, quests, npcs, recipes, sources there are; they are the views that SQL sees too."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], corpus: search.Index | None = None, entities: search.Index | None = None, as_of: str | None = None):
        self.spark, self.tables, self.corpus, self.entities, self.as_of = spark, tables, corpus, entities, as_of
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    def call(self, name: str, corpus: str = "full", **args) -> str:
        tool: Callable[..., str] | None = getattr(self, f"_{name}", None) if name in TOOLS else None
        if tool is None:
            return f"Unknown tool: {name}. Available: {', '.join(TOOLS)}"
        try:
            return capped(tool(args, corpus) if name == "corpus_search" else tool(args))
        except player.Ask as e:
            return str(e)
        except Exception as e:
            return f"{'SQL error: ' if name == 'sql_query' else name + ' error: '}{str(e).splitlines()[0] if str(e) else type(e).__name__}"

    def _table(self, name: str, otherwise: str) -> DataFrame:
        if name not in self.tables:
            raise player.Ask(otherwise)
        return self.tables[name]

    def _sql_query(self, args: dict) -> str:
        text = _needs(args, "sql_query", "sql")
        try:
            found = guard.guarded_sql(self.spark, text)
        except ValueError as e:
            raise player.Ask(f"sql_query error: {e}") from e
        lines = reports.markdown_table(found).split("\n")
        return reports.middle_out_text(lines[:3], lines[3:], ANSWER)

    def _find_entities(self, args: dict) -> str:
        query = _needs(args, "find_entities", "query")
        if self.entities is None:
            raise player.Ask("find_entities error: entity index not built.")
        rows = search.entity_search(self.entities, query, args.get("type")).collect()
        return "0 results." if not rows else f"{len(rows)} results:\n" + "\n".join(f"- {r.type} — {r.name} — {r.snippet or ''}" for r in rows)

    def _get_page(self, args: dict) -> str:
        title = _needs(args, "get_page", "title")
        pages = self._table("wiki_pages", f"No wiki page matching '{title}'.")
        page = pages.filter(F.lower("title") == title.lower()).orderBy("title").limit(1).collect()
        if not page:
            near = [r[0] for r in pages.filter(F.contains(F.lower("title"), F.lit(title.lower()))).select("title").orderBy(F.length("title"), "title").limit(6).collect()]
            if not near:
                return f"No wiki page matching '{title}'."
            more = f" (+{len(near) - 5} more)" if len(near) > 5 else ""
            return f"Ambiguous: '{title}' matches {len(near)} pages. Call get_page again with one of: {', '.join(near[:5])}{more}"
        text = plain(page[0].text or "", page[0].title)
        note = f"…[truncated {len(text) - PAGE} chars]" if len(text) > PAGE else ""
        return f"# {page[0].title}\n{text[:PAGE]}{note}"

    def _corpus_search(self, args: dict, corpus: str) -> str:
        query = _needs(args, "corpus_search", "query")
        if self.corpus is None:
            raise player.Ask("corpus_search error: index not built.")
        try:
            k = int(args.get("k") or 10)
        except (TypeError, ValueError):
            k = 10
        keep = ~F.col("tbl").isin(*search.TOOL_TABLES) if corpus == "tool" else None
        rows = self.corpus.search(query, k, keep, ("name", "tbl")).collect()
        return "0 results." if not rows else f"{len(rows)} results:\n" + "\n".join(f"- {r[self.corpus.key]} | {r.name or r[self.corpus.key]} ({r.tbl}) | {r.snippet}" for r in rows)

    def _corpus_get_doc(self, args: dict) -> str:
        ident = _needs(args, "corpus_get_doc", "id")
        rows = search.reassembled(self._table("documents", f"No document matching '{ident}'."), ident).collect()
        return f"No document matching '{ident}'." if not rows else f"{len(rows)} part(s):\n" + "\n---\n".join(f"## {r.id}\n{r.text or ''}" for r in rows)

    def _player_state(self, args: dict) -> str:
        section = str(args.get("section") or "summary").strip().lower()
        if section not in SECTIONS:
            return f"player_state error: unknown section '{section}'. Use: {', '.join(SECTIONS)}."
        sheets = self._table("char_reports", "There are no reports of any character.")
        who = player.character(sheets, args.get("character"), self.tables.get("stall_events") if section.startswith("stall") else None)
        query = str(args.get("query") or "").strip() or None
        if section == "stall":
            return self._stall(query)
        if section == "stall_inventory":
            return self._inventory(query)
        if section == "items":
            return self._items(who, query)
        row = player.latest_report(sheets, who).collect()
        if not row:
            return f"There is no report of {who}."
        report, out = self.spark.createDataFrame(row, "character string, ts string, report string"), Answer([f"{who}, as of {row[0].ts}"])  # one row
        if section == "abilities":
            return self._abilities(report, out, _needs(args, "player_state abilities", "skill"))
        if section in ("summary", "skills"):
            found = player.skills(report)
            rows = (found.limit(TOP) if section == "summary" else found).collect()
            out.show("skill" if section == "skills" else "top_skill", rows, none="none")
        if section in ("summary", "currencies"):
            out.show("currency", player.currencies(report).collect(), none="none")
        if section in ("summary", "quests"):
            for q in player.quests(report).collect():
                out = out.say(f"{q.n} {q.state} quests") if section == "summary" else out.show(q.state, [{"name": n} for n in q.names], q.n, none="none")
        if section == "favor":
            rows = player.favour(report).collect()
            out.show("favour", rows[:MOST_NAMED], len(rows), none="none")
        if section == "summary":
            out.say(f"Server: {report.select(F.get_json_object('report', '$.ServerName')).first()[0]}")
        return out.text()

    def _items(self, who: str, query: str | None) -> str:
        own = self._table("player_items", "There are no lists of things.").filter(F.col("character") == who)
        shown = reports.markdown_table(player.things(own, who, query)).split("\n")
        if shown[0].startswith("0 rows"):
            return f"{who} has nothing" + (f" like '{query}'." if query else " on record.")
        newest = own.agg(F.max("ts")).first()[0]
        return reports.middle_out_text([f"Things of {who}, as of {newest}", *shown[1:3]], shown[3:], ANSWER)

    def _abilities(self, report: DataFrame, out: Answer, skill: str) -> str:
        unknown = f"player_state abilities error: no abilities of a skill '{skill}'."
        rows = [r.asDict() | {"shown": r.name or r.internal_name, "level": r.level or 0.0} for r in player.ability_audit(report, self._table("abilities", unknown), skill).collect()]
        of = {state: sorted((r for r in rows if r["state"] == state), key=lambda r: (r["level"], r["shown"])) for state in ("known", "missing", "sheet only", "other")}
        if not of["known"] and not of["missing"]:
            return unknown
        if not of["known"] and not of["sheet only"]:
            return out.say(f"The sheet lists no abilities of {skill}, so what is missing can't be told.").text()
        out.show("known", sorted(of["known"], key=lambda r: r["shown"]), none="none").show("missing", of["missing"], none="nothing")
        return out.show("unlisted", of["sheet only"]).show("other", of["other"][:MOST_NAMED], len(of["other"])).text()

    def _stall(self, query: str | None) -> str:
        rows = player.stall_history(self._table("stall_events", "No stall's history has been loaded."), query).collect()
        sold = [r.asDict() | {"total": r.price_total or 0} for r in rows if r.kind == "sold"]
        asking = [r for r in rows if r.kind == "asking"][-MOST_ASKED:]
        if not query:
            if not rows:
                return "The stall has no history."
            return self._dealt(Answer(), sold, asking, len(rows), "").text()
        out, priced = Answer(), bool(sold or asking)
        out.show("value", self._value(query))
        if not priced:
            recipes = self._recipes(query)
            if len(recipes) > 1:
                out.show("recipe", recipes[: player.MOST_RECIPES], recipes[0].n_all)
            out.say(f"The stall has no {'prices' if rows else 'history'} of '{query}'.")
        if {"items", "quests"} <= set(self.tables):
            orders = player.work_orders(self.tables["items"], self.tables["quests"], query).withColumn("payout", grouped_number(F.col("payout"))).withColumn("each", grouped_number(F.col("each")))
            out.show("order", [r.asDict() | {"gain": f" and {r.xp:g} {r.skill} experience" if r.skill else ""} for r in orders.collect()])
        if priced:
            self._dealt(out, sold, asking, len(rows), f" of '{query}'")
        if "stall_price_observations" in self.tables:
            seen = [r.asDict() for r in player.observations(self.tables["stall_price_observations"], query).collect()]
            out.show("seen", [r | {"price": f"{r['price_unit']:g} each" if r["price_unit"] else "without a price yet", "where": _where(r)} for r in seen])
        if "chat_events" in self.tables:
            out.show("said", player.chat_prices(self.tables["chat_events"], query).collect())
        sources = player.sources_of(self.tables["items"], self.tables["sources"], query, **{k: self.tables.get(k) for k in ("npcs", "quests", "recipes")}).collect() if {"items", "sources"} <= set(self.tables) else []
        return out.show("source", sources, none="" if priced else "not known either").text()

    @staticmethod
    def _dealt(out: Answer, sold: list, asking: list, n: int, of: str) -> Answer:
        out.say("Prices below are of this stall's own listings and sales; they are no sample of the market.")
        out.show("sold", sold, none=f"no sales{of}").show("asking", asking)
        return out.say(f"Only the newest {player.NEWEST} events are shown; use sql_query on stall_events for all.") if n >= player.NEWEST else out

    def _value(self, query: str) -> list:
        return [r for r in player.value_or_recipe(self.tables["items"], query).collect() if r.value is not None] if "items" in self.tables else []

    def _recipes(self, query: str) -> list:
        return [r for r in player.recipe_family(self.tables["items"], query).collect() if r.value is not None] if "items" in self.tables else []

    def _inventory(self, query: str | None) -> str:
        events = self._table("stall_events", "No stall's history has been loaded.").filter("ignored = 0 and owner is not null")
        counts = self.tables.get("stall_inventory_baseline")
        if query:
            events = events.filter(name_like(F.col("item"), query))
            counts = None if counts is None else counts.filter(name_like(F.col("item"), query))
        owners = [r[0] for r in events.select("owner").distinct().limit(2).collect()]
        if not owners:
            return f"The stall never held anything{' like ' + repr(query) if query else ''}."
        if len(owners) > 1:
            return "Several stalls match; ask with query=<item>."
        rows = ledger.inventory(events, None if counts is None else counts.filter(F.col("owner") == owners[0]), as_of=self.as_of).orderBy("item", "place").collect()
        listed: dict[str, list] = {}
        for r in rows:
            if r.status == "listed":
                listed.setdefault(r["item"], []).append(r)
        shown = [{"item": i, "quantity": sum(t.quantity for t in ts), "tiers": ", ".join(f"{t.quantity} " + ("without a price" if t.price is None else f"for {t.price:g} each") for t in ts)} for i, ts in listed.items()]
        return Answer().show("listed", shown, none="nothing with a price").show("unpriced", [r for r in rows if r.status != "listed"]).text()


def _where(seen: dict) -> str:
    parts = [f"at {seen['stall_label']}" if seen.get("stall_label") else "", f"of {seen['owner_name']}" if seen.get("owner_name") else "", f"by {seen['source']}" if seen.get("source") else "", str(seen.get("notes") or "")[:120]]
    return "".join(f", {p}" for p in parts if p)
