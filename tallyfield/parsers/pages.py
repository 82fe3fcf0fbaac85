"""What schedule and box-score pages say, as raw text cells: one small helper for each layout.

Helpers only find cells. Names, dates, sides, scores, status and keys are column expressions in
``schedule`` and ``box``. Class names and element ids are fixed values of the page formats.
Payload slots that are pointers are followed one hop; page code is never evaluated.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

from .dom import Node, parse, text_of

GAME = ["opponent", "date_text", "date_attrs", "date_iso", "side", "result", "box", "home", "away", "left", "separator", "right"]
PLAYER = ["team", "jersey", "player", "position", "minutes", "goals", "assists", "shots", "shots_on_goal", "saves", "goals_allowed"]
#: Fixed values of payload scripts: the id of the JSON one, what other ones hold, and where their list starts.
PAYLOAD_ID, PAYLOAD_WORDS, PAYLOAD_MARK = "__NUXT_DATA__", ('"schedule":', "ShallowReactive"), '[["ShallowReactive"'
#: Members of a payload's objects that are followed further have one of these in their names.
FOLLOWED = ("result", "opponent", "date", "location", "schedule", "schedules", "games", "game_links", "boxscore")
MOST_HOPS = 8


def box_link(node: Node) -> str:
    links = node.all("a")
    said = [a for a in links if re.search(r"box|recap|stats", a.text(), re.I)]
    shaped = [a for a in links if re.search(r"boxscore|/stats/", a.attrs.get("href", ""))]
    return next((a.attrs["href"] for a in [*said, *shaped] if a.attrs.get("href")), "")


def table_box_link(row: Node) -> str:
    """By an anchor's text, by its address, then any boxscore address or JSON member within the row."""
    links = row.all("a")
    said = [a for a in links if "box score" in (t := a.text().strip().lower()) or t == "box"]
    shaped = [a for a in links if re.search(r"boxscore|/stats/", a.attrs.get("href", ""), re.I)]
    if said or shaped:
        return (said or shaped)[0].attrs.get("href", "")
    other = next((h for n in row.below() if "boxscore" in (h := n.attrs.get("href", "")).lower()), "")
    return other or (m[1] if (m := re.search(r'"boxscore"\s*:\s*"([^"]+)"', row.text(), re.I)) else "")


def side_of(word: str) -> str:
    word = word.strip().lower().rstrip(".")
    return {"at": "away", "vs": "home"}.get(word, "unknown")


def cards(page: Node) -> Iterator[dict]:
    for card in page.all(cls="s-game-card"):
        team = card.first(cls="s-game-card__header__team")
        date = card.first(where=lambda n: n.attrs.get("data-test-id") == "s-game-card-standard__header-game-date-details")
        yield {
            "opponent": text_of(team and team.first(cls="s-text-paragraph-bold")) or "Unknown Opponent",
            "date_text": text_of(date and date.first("span")),
            "side": side_of(text_of(card.first(cls="s-stamp__text"))),
            "result": text_of(card.first(cls="c-scoreboard__scores")),
            "box": box_link(card),
        }


def scoreboard(page: Node) -> Iterator[dict]:
    for item in page.all(cls="c-scoreboard__item"):
        logo, date = item.first(cls="c-scoreboard__logo"), item.first(cls="c-scoreboard__date")
        image = logo and logo.first("img")
        side = next((s for s in ("home", "away") if f"c-scoreboard__item--{s}" in item.classes), side_of(text_of(item.first(cls="c-scoreboard__atvs"))))
        yield {
            "opponent": (image.attrs.get("alt", "").strip() if image else "") or "Unknown Opponent",
            "date_text": text_of(date and date.first("span")),
            "side": side,
            "result": f"{text_of(item.first(cls='c-scoreboard__scores'))} {text_of(item.first(cls='c-scoreboard__status'))}",
            "box": box_link(item),
        }


def list_items(page: Node) -> Iterator[dict]:
    for item in page.all("li", cls="sidearm-schedule-game"):
        date = item.first(cls="sidearm-schedule-game-opponent-date")
        if opponent := text_of(item.first(cls="sidearm-schedule-game-opponent-name")):
            yield {
                "opponent": opponent,
                "date_text": text_of(date and date.first("span")),
                "side": "home" if "sidearm-schedule-home-game" in item.classes else "away",
                "result": text_of(item.first(cls="sidearm-schedule-game-result")),
                "box": box_link(item),
            }


LABEL = re.compile(r"\b(date|opponents?|teams|results?)\b")
DATE_ATTRS = ("data-game-date", "data-date", "data-datetime")
NO_OPPONENT = re.compile(r"\d{1,2}:\d{2}|\d{1,2}/\d{1,2}|[A-Za-z]+\s*\d{1,2}|\d+\s*-\s*\d+|(?i:postponed|cancel)")
OUTCOME = re.compile(r"(?i)\d+\s*-\s*\d+|postponed|cancel")


def inside(node: Node, *tags: str) -> Node | None:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node


def texts_of(row: Node) -> list[str]:
    return [text_of(c).lower() for c in row.all("th", "td")]


def names_columns(row: Node) -> bool:
    """Only th cells, one a label or several; or two labels and no digits among td cells."""
    heads = texts_of(row)
    if row.all("td"):
        return not re.search(r"\d", " ".join(heads)) and sum(bool(LABEL.search(h)) for h in heads) > 1
    return len(heads) > 1 or any(LABEL.search(h) for h in heads)


def headed_rows(table: Node) -> Iterator[tuple[list[str], Node]]:
    """A table's rows of games, each with the column names of the head, else of the nearest row above that names columns, else of a row of a header class."""
    rows = [r for r in table.all("tr") if inside(r, "table") is table]
    head = [r for r in rows if inside(r, "thead", "table") is not table]
    classed = [r for r in rows if r not in head and "header" in r.attrs.get("class", "")]
    heads = next((h for h in map(texts_of, head) if LABEL.search(" ".join(h))), [t for r in head for t in texts_of(r)])
    last = heads or [t for r in classed for t in texts_of(r)]
    for row in rows:
        if row in head or row in classed:
            continue
        if names_columns(row):
            last = heads or texts_of(row)
        else:
            yield last, row


def opponent_cell(cells: list[Node]) -> Node:
    """Where no header tells: the first inner cell of five characters that is no time, date or outcome, then by position."""
    likely = (c for c in cells[1:-1] if len(t := text_of(c)) >= 5 and not NO_OPPONENT.match(t))
    return next(likely, cells[min(3, len(cells) - 2)])


def result_cell(cells: list[Node], taken: tuple[Node | None, ...]) -> Node | None:
    """Where no header tells: a score, postponed or canceled in the last three cells, then the last but one."""
    free = [c for c in cells[-3:] if c not in taken]
    return next((c for c in free if OUTCOME.search(text_of(c))), cells[-2] if cells[-2] not in taken else None)


def iso_date(node: Node) -> str:
    """The first ISO date in what is within an element, attributes included."""
    said = " ".join([*(v for n in node.below() for v in n.attrs.values()), node.text()])
    return m[0] if (m := re.search(r"\d{4}-\d{2}-\d{2}", said)) else ""


def table_rows(page: Node) -> Iterator[dict]:
    for table in page.all("table"):
        known = None
        for heads, row in headed_rows(table):
            if heads is not known:  # most rows have the names of the row before
                known, at = heads, {x: next((i for i, h in enumerate(heads) if x in h), None) for x in ("date", "opponent", "teams", "result")}
                told = at["opponent"] is not None or at["teams"] is not None
                other = heads and set(heads) <= {"team", "period", "f"}
            cells = row.all("th", "td")
            column = lambda label: cells[i] if (i := at[label]) is not None and i < len(cells) else None  # noqa: B023, E731
            if len(cells) < (2 if told else 3) or not text_of(row) or other:
                continue
            date = column("date") or cells[0]
            opponent = (column("opponent") or column("teams")) if told else opponent_cell(cells)
            if opponent is None:
                continue
            result = column("result") if at["result"] is not None else result_cell(cells, (date, opponent))
            name = next((n for c in ("schedule-event-item-team__opponent-name", "schedule-default-team__opponent-name") if (n := opponent.first(cls=c))), None)
            stamp = next((text_of(n) for c in ("schedule-event-item-team__divider--desktop", "schedule-default-team__divider") if (n := opponent.first(cls=c))), "")
            said = f"{stamp} {name.own_text()}".strip() if name else ""
            said = said or " ".join(opponent.text(without={"schedule-event-item-team__promo-title", "schedule-event-item-team__divider"}).split())
            lead = re.match(r"(?i)(at|vs)\.?\s+", said)
            yield {
                "opponent": (said[lead.end() :] if lead else said) or "Unknown Opponent",
                "date_text": text_of(date),
                "date_attrs": "\n".join(n.attrs[k] for n in (date, row) for k in DATE_ATTRS if n.attrs.get(k)),
                "date_iso": iso_date(row),
                "side": side_of(lead[1] if lead else ""),
                "result": text_of(result),
                "box": table_box_link(row),
            }


def walk(value: Any) -> Iterator[dict]:
    if isinstance(value, list):
        for x in value:
            yield from walk(x)
    elif isinstance(value, dict):
        yield value
        yield from walk(value.get("@graph", []))


def said_name(value: Any) -> str:
    value = value[0] if isinstance(value, list) and value else value
    return (value.get("name") or value.get("Team") or "" if isinstance(value, dict) else value if isinstance(value, str) else "").strip()


def linked_data(page: Node) -> Iterator[dict]:
    for script in page.all("script", where=lambda n: n.attrs.get("type") == "application/ld+json"):
        try:
            events = list(walk(json.loads(script.text())))
        except ValueError:
            continue
        for event in events:
            kind, date = event.get("@type"), next((event[k] for k in ("startDate", "start_date", "date") if event.get(k)), "")
            if "SportsEvent" in (kind if isinstance(kind, list) else [kind]) and date:
                title = re.search(r"(?i)(.+?)\s+(vs\.?|at)\s+(.+)", " ".join(str(event.get("name") or "").split()))
                scores = [first_score(event.get(f"{side}Team"), event.get(f"{side}Score"), f"{side}Score") for side in ("home", "away")]
                yield {
                    "date_text": str(date).split("T")[0],
                    "home": said_name(event.get("homeTeam")),
                    "away": said_name(event.get("awayTeam")),
                    **(dict(zip(("left", "separator", "right"), (title[1].strip(), title[2].lower(), title[3].strip()), strict=True)) if title else {}),
                    "side": "both",
                    "result": "-".join(scores) if all(scores) else "",
                }


def leading_int(value: Any) -> str:
    """The digits that a number or text starts with; no sign, as scores have none."""
    return m[1] if isinstance(value, int | float | str) and (m := re.match(r"\s*\+?(\d+)", str(value))) else ""


def first_score(team: Any, score: Any, name: str) -> str:
    of_team = (team.get("score"), team.get(name)) if isinstance(team, dict) else ()
    return leading_int(next((v for v in (*of_team, score) if v is not None), None))


def sliced(text: str, start: int) -> list:
    """The list that starts there, to its closing bracket; brackets within strings don't count. Of one that is cut off, what is whole."""
    decoder, found, at = json.JSONDecoder(), [], start + 1
    while at < len(text):
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:  # the closing bracket, the end of the page, or something that isn't JSON
            break
        found.append(value)
    return found


def payload(page: Node) -> list:
    """The list of the JSON script, else the first list behind a mark of another payload script that names a schedule."""
    script = page.first("script", where=lambda n: n.attrs.get("id") == PAYLOAD_ID)
    try:
        found = json.loads(script.text()) if script else []
    except ValueError:
        found = []
    if isinstance(found, list) and found:
        return found
    text = next((t for n in page.all("script") if all(w in (t := n.text()) for w in PAYLOAD_WORDS)), "")
    lists = (sliced(text, m.start()) for m in re.finditer(re.escape(PAYLOAD_MARK), text))
    return next((x for x in lists if config_of(x)), [])


def config_of(data: list) -> dict | None:
    return next((x for x in data if isinstance(x, dict) and x.get("schedule")), None)


def slot(data: list, value: Any) -> Any:
    """A number points to a place of the list; beyond its end there is nothing."""
    if isinstance(value, bool) or not isinstance(value, int):
        return value
    return data[value] if 0 <= value < len(data) else None


@lru_cache(10_000)
def followed(member: str, names: tuple[str, ...]) -> bool:
    return any(f in member.lower() for f in names)


def resolved(data: list, value: Any, names: tuple[str, ...] = FOLLOWED, hops: int = 0) -> Any:
    """Objects and lists with their slots filled in; only members with one of ``names`` in theirs are followed further."""
    if hops > MOST_HOPS:
        return value
    if isinstance(value, list):
        return [resolved(data, slot(data, v), names, hops + 1) for v in value]
    if isinstance(value, dict):
        return {k: resolved(data, slot(data, v), names, hops + 1) if followed(k, names) else slot(data, v) for k, v in value.items()}
    return value


def link_of(value: Any) -> str:
    """A box-score link said as text, number, list or object."""
    if isinstance(value, list):
        value = next((x for x in value if isinstance(x, str) or isinstance(x, dict) and isinstance(x.get("url"), str)), "")
        return value if isinstance(value, str) else value["url"]
    if isinstance(value, dict):
        return next((value[k] for k in ("url", "href", "link") if isinstance(value.get(k), str)), "")
    return str(value) if value and isinstance(value, int | float | str) and not isinstance(value, bool) else ""


def payload_games(page: Node) -> Iterator[dict]:
    data = payload(page)
    config = config_of(data)
    box = slot(data, config["schedule"]) if config else None
    lists = slot(data, box.get("schedules")) if isinstance(box, dict) else None
    first = slot(data, next(iter(lists.values()))) if isinstance(lists, dict) and lists else None
    games = slot(data, first.get("games")) if isinstance(first, dict) else None
    for at in games if isinstance(games, list) else []:
        game = resolved(data, slot(data, at))
        if not isinstance(game, dict) or not isinstance(game.get("date"), str) or not game["date"]:
            continue
        result = game.get("result") if isinstance(game.get("result"), dict) else {}
        opponent = game.get("opponent") if isinstance(game.get("opponent"), dict) else {"title": game.get("opponent")}
        scores = [leading_int(result.get(k)) for k in ("team_score", "opponent_score")]
        said = str(game.get("status") or "") if result else ""
        of_status = next((w for w in ("canceled", "postponed") if w[:4] in said.lower()), "")
        links = game.get("game_links") if isinstance(game.get("game_links"), list) else []
        other = next((x for x in links if isinstance(x, dict) and "box score" in str(x.get("title") or "").lower()), {})
        yield {
            "opponent": said_name({"name": opponent.get("title") or opponent.get("name")}) or "Unknown Opponent",
            "date_text": game["date"].split("T")[0],
            "side": {"H": "home", "A": "away"}.get(game.get("location_indicator"), "neutral"),
            "result": "-".join(scores) if all(scores) else of_status,
            "box": link_of(result.get("boxscore")) or link_of(other.get("url") or other),
        }


#: Layouts in order of priority; the first of ALONE that finds games is the only one used.
ALONE = {"payload": payload_games}
TOGETHER = {"cards": cards, "list": list_items, "table": table_rows, "scoreboard": scoreboard, "linked": linked_data}


def game_cells(page: Node) -> list[tuple]:
    """(layout, position, GAME...) of every game on a page."""
    for layouts in (ALONE, TOGETHER):
        rows = [(layout, i, *[x.get(k, "") for k in GAME]) for layout, find in layouts.items() for i, x in enumerate(find(page))]
        if rows:
            return rows
    return []


def read_schedule(html: str | None) -> tuple[str | None, str, str | None, list[tuple]]:
    """The year of the headings, the canonical link, what went wrong, and the games' cells."""
    page = None
    try:
        page = parse(html)
        heads = (re.search(r"\b(20\d{2})\b", n.text()) for n in page.all("h1", "h2", "h3"))
        canonical = page.first("link", where=lambda n: n.attrs.get("rel") == "canonical")
        return next((m[1] for m in heads if m), None), canonical.attrs.get("href", "") if canonical else "", None, game_cells(page)
    except Exception as error:  # a page that can't be read is listed, and doesn't end the job
        return None, "", f"{type(error).__name__}: {error}"[:200], []
    finally:
        if page is not None:
            page.drop()


def classic_box(page: Node) -> Iterator[dict]:
    """Position, number, player, shots, on goal, goals, assists, minutes."""
    tables = [t for t in page.all("table", cls="sidearm-table") if "overall-stats" in t.classes] or page.all("table", cls="w-full") or page.all("table")
    for table in tables:
        team = text_of(table.first("caption"))
        for row in table.all("tr"):
            cells = [text_of(c) for c in row.all("td")]
            if len(cells) >= 8:
                yield {"team": team, "saves": "0"} | dict(zip(["position", "jersey", "player", "shots", "shots_on_goal", "goals", "assists", "minutes"], cells, strict=False))


def advanced_box(page: Node) -> Iterator[dict]:
    """As above, and tables of goalkeepers: position, number, player, minutes, goals allowed, saves."""
    for table in page.all("table", cls="advanced-table__table"):
        team = text_of(table.first("th"))
        rows = [r for r in ([text_of(c) for c in row.all("td")] for row in table.all("tr")) if r]
        for cells in (r for r in rows if len(r) == len(rows[0])):
            names = ["minutes", "goals_allowed", "saves"] if len(cells) == 6 else ["shots", "shots_on_goal", "goals", "assists", "minutes"]
            yield {"team": team} | dict(zip(["position", "jersey", "player", *names], cells, strict=False))


def payload_box(page: Node) -> Iterator[dict]:
    data = payload(page)
    for team in data:
        if not (isinstance(team, dict) and {"players", "id", "name"} <= team.keys()):
            continue
        players = slot(data, team["players"])
        for at in players if isinstance(players, list) else []:
            p = resolved(data, slot(data, at), ("shots", "goalie"))
            if not isinstance(p, dict):
                continue
            shots, keeper = (p.get(k) if isinstance(p.get(k), dict) else {} for k in ("shots", "goalie"))
            yield {
                "team": str(slot(data, team["name"]) or "Unknown"),
                "jersey": p.get("uniform"),
                "player": p.get("name") or p.get("playerFirstLastName"),
                "position": p.get("position"),
                "minutes": p.get("minutesPlayed") or keeper.get("minutes"),
                "goals": shots.get("goals"),
                "assists": shots.get("assists"),
                "shots": shots.get("shots"),
                "shots_on_goal": shots.get("shotsOnGoal"),
                "saves": keeper.get("saves"),
            }


def box_cells(html: str | None) -> tuple[str | None, list[tuple]]:
    """What went wrong, and (layout, position, PLAYER...) by the first layout that finds players."""
    try:
        page = parse(html)
        for layout, find in (("payload", payload_box), ("advanced", advanced_box), ("classic", classic_box)):
            rows = [(layout, i, *[None if x.get(k) is None else str(x[k]) for k in PLAYER]) for i, x in enumerate(find(page))]
            if rows:
                return None, rows
        return None, []
    except Exception as error:
        return f"{type(error).__name__}: {error}"[:200], []
