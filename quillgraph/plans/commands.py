"""The command language: find, search, cat, info, ls, stats, help. Errors become text."""

from __future__ import annotations

import argparse
import json
import shlex

from pyspark.sql import functions as F

from quillgraph.operators import graph
from quillgraph.plans.knowledge import KnowledgeBase

HELP = """find --entity|--topic {"name": ..., "definition": ...}
search --entity 'A, B' [--mode around|between] [--query TEXT] [--from DATE] [--to DATE] [--limit N]
cat N...            the numbered results of the last search in full
info NAME           an entity with its facts and neighbours, or a topic
ls entities|topics|documents [--type TYPE] [--limit N]
stats, help"""


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise ValueError(message)


def selector(text: str) -> dict:
    """A JSON object with a name and a definition, neither empty."""
    try:
        got = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"not JSON: {e}") from None
    if not isinstance(got, dict) or not all(isinstance(got.get(k), str) and got[k].strip() for k in ("name", "definition")):
        raise ValueError("a selector is an object with a name and a definition")
    return got


def blocks(text: str) -> list[str]:
    """Words, with a {...} block as one whatever is in it."""
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
        elif text[at] == "{":
            _, end = json.JSONDecoder().raw_decode(text, at)
            out.append(text[at:end])
            at = end
        else:
            end = at
            while end < len(text) and not text[end].isspace() and text[end] != "{":
                end += 1
            out.append(text[at:end])
            at = end
    return out


def names(text: str) -> list[str]:
    return list(dict.fromkeys(x for x in (p.strip() for p in text.split(",")) if x))


class Session:
    """Remembers the last search, so its rows can be asked for by number."""

    def __init__(self, kb: KnowledgeBase) -> None:
        self.kb, self.results = kb, []

    def run(self, line: str) -> str:
        verb, _, rest = line.strip().partition(" ")
        act = {"find": self.find, "search": self.search, "cat": self.cat, "info": self.info, "ls": self.ls, "stats": self.stats, "help": lambda _: HELP}.get(verb)
        if act is None:
            return f"Error: unknown command {verb!r}; see help"
        try:
            return act(rest)
        except Exception as e:  # noqa: BLE001 the session goes on
            return f"Error: {e}"

    def find(self, rest: str) -> str:
        p = _Parser(prog="find", add_help=False)
        p.add_argument("--entity")
        p.add_argument("--topic")
        a = p.parse_args(blocks(rest))
        if bool(a.entity) == bool(a.topic):
            raise ValueError("find takes --entity or --topic")
        s = selector(a.entity or a.topic)
        ask = f"{s['name']}: {s['definition']}"
        got = self.kb.search_entities(ask, 5) if a.entity else self.kb.search_topics(ask, 5, 0.3)
        return "\n".join(f"{r['name']} ({int(r['score'] * 100)}%)" for r in got.collect()) or "Nothing found."

    def search(self, rest: str) -> str:
        p = _Parser(prog="search", add_help=False, allow_abbrev=False)
        p.add_argument("--entity", "-entity", required=True)
        p.add_argument("--mode", default="around")
        p.add_argument("--query")
        p.add_argument("--from", dest="since")
        p.add_argument("--to", dest="until")
        p.add_argument("--limit", type=int, default=20)
        a = p.parse_args(shlex.split(rest))
        got = self.kb.hybrid(names(a.entity), a.query, a.mode, a.since, a.until, a.limit)
        order = [F.desc("score")] if a.query else [F.desc_nulls_last("document_date")]
        self.results = got.orderBy(*order, "uuid").collect()
        return "\n".join(f"[{k}] {r['subject_name']} {r['relationship_type']} {r['object_name']} ({r['document_name']})" for k, r in enumerate(self.results, 1)) or "Nothing found."

    def cat(self, rest: str) -> str:
        wanted = [int(x) for x in rest.split()]
        if not wanted or not all(1 <= k <= len(self.results) for k in wanted):
            raise ValueError(f"cat takes numbers from 1 to {len(self.results)}")
        chunks = {r["uuid"]: r["content"] for r in graph.by_uuids(self.kb.store.read("chunks"), {self.results[k - 1]["chunk_uuid"] for k in wanted}).collect()}
        return "\n\n".join(f"[{k}] {self.results[k - 1]['content']}\n{chunks.get(self.results[k - 1]['chunk_uuid'], '')}" for k in wanted)

    def info(self, rest: str) -> str:
        name = rest.strip().strip("'\"").replace("_", " ")
        e = self.kb.entity(name).first()
        if e is None:
            t = graph.by_name(self.kb.store.read("topics", "ontology"), name).first()
            return f"{t['name']}: {t['definition']}" if t else f"No entity or topic {name!r}."
        facts = graph.entity_facts(self.kb.store.read("facts"), e["name"], 1000).collect()
        near = self.kb.neighbours(e["name"], 100).collect()
        return "\n".join([f"{e['name']} ({e['entity_type'].upper()})", e["summary"], f"Facts: {len(facts)}", *(f"  {f['subject_name']} {f['relationship_type']} {f['object_name']}" for f in facts), "Neighbours: " + ", ".join(f"{n['name']} ({n['n']})" for n in near)])

    def ls(self, rest: str) -> str:
        p = _Parser(prog="ls", add_help=False)
        p.add_argument("what", choices=("entities", "topics", "documents"))
        p.add_argument("--type")
        p.add_argument("--limit", type=int, default=20)
        a = p.parse_args(shlex.split(rest))
        s = self.kb.store
        if a.what == "entities":
            return "\n".join(f"{r['name']} {r['entity_type'].upper()} {r['n_facts']}" for r in graph.listing(s.read("entities"), s.read("facts"), a.type, a.limit).orderBy("name", "uuid").collect())
        if a.what == "topics":
            return "\n".join(r["name"] for r in graph.page(s.read("topics", "ontology"), a.limit).collect())
        return "\n".join(r["name"] for r in s.read("documents").orderBy(F.desc("created_at"), "uuid").limit(a.limit).collect())

    def stats(self, rest: str = "") -> str:
        return "\n".join(f"{k}: {n}" for k, n in sorted(self.kb.stats().items()))
