"""Note packages: a zip with a SQLite collection, in the public format of flashcard programs.

Written on the driver from a deck at a time: a package is one file for one person.
"""

from __future__ import annotations

import json
import sqlite3
import tempfile
import time
import zipfile
import zlib
from pathlib import Path

from pyspark.sql import DataFrame

_TABLES = """
create table col (id integer primary key, crt integer, mod integer, scm integer, ver integer, dty integer, usn integer, ls integer, conf text, models text, decks text, dconf text, tags text);
create table notes (id integer primary key, guid text, mid integer, mod integer, usn integer, tags text, flds text, sfld text, csum integer, flags integer, data text);
create table cards (id integer primary key, nid integer, did integer, ord integer, mod integer, usn integer, type integer, queue integer, due integer, ivl integer, factor integer, reps integer, lapses integer, left integer, odue integer, odid integer, flags integer, data text);
create table revlog (id integer primary key, cid integer, usn integer, ease integer, ivl integer, lastIvl integer, factor integer, time integer, type integer);
create table graves (usn integer, oid integer, type integer);
"""


def stable_number(name: str) -> int:
    """A 31-bit id that depends on the name alone."""
    return (1 << 30) + zlib.crc32(name.encode()) % (1 << 30)


def _model(name: str, fields: list[str], cloze: bool) -> dict:
    shown = "{{cloze:%s}}" % fields[0] if cloze else "{{%s}}" % fields[0]
    rest = "<br>".join("{{%s}}" % f for f in fields[1:])
    templates = [{"name": "Card 1", "ord": 0, "qfmt": shown, "afmt": f"{shown}<hr id=answer>{rest}", "did": None, "bqfmt": "", "bafmt": ""}]
    made = [{"name": f, "ord": n, "font": "Arial", "size": 20, "media": [], "rtl": False, "sticky": False} for n, f in enumerate(fields)]
    return {"id": stable_number(name), "name": name, "type": int(cloze), "mod": 0, "usn": -1, "sortf": 0, "did": 1, "tmpls": templates, "flds": made, "css": ".card {font-family: arial}", "latexPre": "", "latexPost": "", "tags": [], "vers": [], "req": [[0, "any", [0]]]}


def write_package(notes: DataFrame, path: str | Path, media: dict[str, bytes] | None = None, orders: dict[str, list[str]] | None = None) -> int:
    """Notes (id, layout, deck, fields, tags) as a package; the number written. A note's
    guid comes from its id, so a second import updates it. Rows are streamed. ``orders``
    has the fields of each layout, the asking one first; else they stand as in the map."""
    now = int(time.time())
    with tempfile.TemporaryDirectory() as folder:
        db = sqlite3.connect(Path(folder) / "collection.anki2")
        db.executescript(_TABLES)
        models, decks, n = {}, {"1": {"id": 1, "name": "Default", "conf": 1, "extendNew": 0, "extendRev": 0, "collapsed": False, "desc": "", "dyn": 0, "lrnToday": [0, 0], "mod": 0, "newToday": [0, 0], "revToday": [0, 0], "timeToday": [0, 0], "usn": -1}}, 0
        for row in notes.toLocalIterator():
            fields = dict(row.fields)
            model = models.setdefault(row.layout, _model(row.layout, (orders or {}).get(row.layout, list(fields)), any("{{c1::" in (v or "") for v in fields.values())))
            names = [f["name"] for f in model["flds"]]
            deck = stable_number(row.deck)
            decks.setdefault(str(deck), decks["1"] | {"id": deck, "name": row.deck})
            values = [fields.get(name) or "" for name in names]
            n += 1
            db.execute("insert into notes values (?,?,?,?,?,?,?,?,?,?,?)", (n, f"card-{row.id}", model["id"], now, -1, f" {' '.join(row.tags)} ", "\x1f".join(values), values[0], zlib.crc32(values[0].encode()), 0, ""))
            db.execute("insert into cards values (?,?,?,0,?,-1,0,0,?,0,0,0,0,0,0,0,0,'')", (n, n, deck, now, n))
        db.execute("insert into col values (1,?,?,?,11,0,0,0,?,?,?,'{}','{}')", (now, now * 1000, now * 1000, "{}", json.dumps({str(m["id"]): m for m in models.values()}), json.dumps(decks)))
        db.commit()
        db.close()
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as package:
            package.write(Path(folder) / "collection.anki2", "collection.anki2")
            files = list((media or {}).items())
            package.writestr("media", json.dumps({str(k): name for k, (name, _) in enumerate(files)}))
            for k, (_, content) in enumerate(files):
                package.writestr(str(k), content)
    return n
