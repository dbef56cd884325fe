"""Small stored graphs used by several tests: a clinic, a garden shop and a print office."""

import json


def field(label, kind="text", required=False, options=None):
    return {"label": label, "type": kind, "required": required, "options": options, "value": None, "placeholder": "", "selector": "#" + label.lower().replace(" ", "-")}


def form(title, *fields):
    return {"title": title, "isDialog": True, "fields": list(fields), "submitButtons": ["Keep"], "submitSelector": "#keep", "fieldCount": len(fields)}


def page(host, key, path, label, depth, *collections):
    out = {"id": key, "url": f"https://{host}{path}", "label": label, "depth": depth}
    return out | ({"collections": list(collections)} if collections else {})


def rows(kind, *items):
    return {"kind": kind, "count": len(items), "items": [{"t": t, "cells": list(cells), "level": 0} for t, *cells in items]}


def click(a, b, label, selector, kind="link"):
    return {"from": a, "to": b, "label": label, "selector": selector, "kind": kind}


# the ward is two clicks deep, samples lie behind the lab, nothing leads to the cellar
CLINIC = {
    "meta": {"start": "https://clinic.test/desk", "host": "clinic.test", "states": 6, "edges": 5, "triggers": 3},
    "states": [
        page("clinic.test", "k0", "/desk", "/desk", 0),
        page("clinic.test", "k1", "/ward", "Ward", 1, rows("list", ("Nadia Okafor",), ("Tom Reyes",))),
        page("clinic.test", "k2", "/ward/beds", "Beds", 2),
        page("clinic.test", "k3", "/lab", "Lab", 1),
        page("clinic.test", "k4", "/lab/samples", "Samples", 2, rows("table", ("", "Batch 7", "2031-03-02"), ("", "Batch 8", "2031-04-09"), ("", "Batch 9", "2031-05-11"))),
        page("clinic.test", "k5", "/cellar", "Cellar", 1),
    ],
    "edges": [
        click("k0", "k1", "Ward", "#ward"), click("k1", "k2", "Beds tab", "#beds", "click"), click("k0", "k3", "Lab", "#lab"),
        click("k3", "k4", "Samples", "#samples"), click("k4", None, "Nowhere", "#x"),
    ],
    "triggers": [
        {"label": "Create Bed", "state": "k2", "path": [{"label": "Ward", "selector": "#ward", "href": "https://clinic.test/ward"}, {"label": "Beds tab", "selector": "#beds", "href": None}],
         "form": form("Create Bed", field("Bed Number", required=True), field("Side", "select", options=["left", "right"])), "opensAt": None},
        {"label": "Add Sample", "state": "k4", "path": [{"label": "Lab", "selector": "#lab", "href": None}, {"label": "Samples", "selector": "#samples", "href": None}],
         "form": form("Sample", field("Tube", required=True)), "opensAt": "https://clinic.test/lab/samples/new"},
        {"label": "New Incident", "state": "k5", "path": [{"label": "Cellar", "selector": "#c", "href": None}], "form": form("Incident", field("What"), field("When"), field("Who"))},
    ],
}

GARDEN = {
    "meta": {"host": "garden.test"},
    "states": [
        page("garden.test", "g0", "/", "", 0), page("garden.test", "g1", "/about", "About", 1),
        page("garden.test", "g2", "/buyers", "Buyers", 1, rows("list", ("Nadia Berg",), ("Rake Seven",), ("nadia q",))),
    ],
    "edges": [click("g0", "g1", "About", "#a"), click("g0", "g2", "Buyers", "#b")],
    "triggers": [],
}

PRESS = {
    "meta": {"host": "press.test"},
    "states": [page("press.test", "r0", "/", "Home", 0), page("press.test", "r1", "/prints", "Prints", 1), page("press.test", "r2", "/desks", "Desks", 1), page("press.test", "r3", "/signs", "Signs", 1)],
    "edges": [click("r0", "r1", "Prints", "#p"), click("r0", "r2", "Desks", None, "iframe"), click("r0", "r3", "Signs", "#s")],
    "triggers": [
        {"label": "Download the May atlas", "state": "r1", "path": [], "form": None, "kind": "download", "selector": "#may", "href": "http://press.test/out/may-atlas.pdf"},
        {"label": "Download the floor plan", "state": "r1", "path": [], "form": None, "kind": "download", "selector": "#plan", "href": None},
        {"label": "Open a new desk", "state": "r2", "path": [], "form": form("desk"), "kind": "form", "selector": "#d"},
        {"label": "Signpost colors", "state": "r3", "path": [], "form": form("Colors", field("Paint")), "kind": "form", "selector": "#c"},
    ],
}

ALL = {"clinic.test": CLINIC, "garden.test": GARDEN, "press.test": PRESS}


def write(folder, docs=ALL):
    for host, doc in docs.items():
        (folder / f"{host}.json").write_text(json.dumps(doc, indent=2))
    return str(folder)
