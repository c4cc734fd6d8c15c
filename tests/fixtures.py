"""Small invented bronze documents with the awkward rows of the real snapshots."""

from __future__ import annotations

import json
import os

# The keys of all documents below are those of the source's files.
STAMP_1 = {"extraction_timestamp": "2026-03-14 09:00:00", "load_date": "2026-03-14", "source": "test"}
STAMP_2 = {"extraction_timestamp": "2026-03-21 09:00:00", "load_date": "2026-03-21", "source": "test"}


def _write(path: str, doc) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, ensure_ascii=False)


def _standing(rank, team, played, w, d, l, gf, ga, pts, xgf, xga):
    url = f"https://example.test/team/{team.replace(' ', '_')}"
    return {"Team": team, "URL": url,
            "Data": [str(rank), team, url, str(played), str(w), str(d), str(l), str(gf), str(ga), str(pts),
                     xgf, xga, "1.0"]}


LEAGUE_OLD = [
    _standing(1, "Northside", 10, 6, 2, 2, 20, 10, 20, "18.50", "9.10"),
    _standing(2, "Harbour City", 10, 5, 3, 2, 15, 11, 18, "14.00", "12.25"),
]
LEAGUE_NEW = [
    _standing(1, "Northside", 11, 7, 2, 2, 22, 10, 23, "60.74", "25.04"),
    _standing(2, "Harbour City", 11, 5, 3, 3, 15, 13, 18, "14.90", "13.00"),
    _standing(3, "Brighton", 11, 4, 4, 3, 14, 12, 16, "13.10", "12.00"),
    _standing(4, "Ålesund Rovers", 11, 1, 2, 8, 6, 25, 5, "", "20.00"),
]


def _result(date, opp, side, res, ts, os_, txg, oxg):
    return {"date": date, "opponent": opp, "side": side, "result": res, "team_score": ts,
            "opponent_score": os_, "team_xg": txg, "opponent_xg": oxg, "match_link": ""}


def _stat(sit, sh, g, xg, xgsh):
    return {"№": "1", "Situation": sit, "Sh": sh, "G": g, "ShA": "10", "GA": "2", "xG": xg, "xGA": "1.5",
            "xGD": "0.5", "xG/Sh": xgsh, "xGA/Sh": "0.1"}


TEAMS = {
    "northside": {
        "team_name": "Northside", "url": "u1",
        "results": [
            _result("Sep 29, 2025", "Harbour City", "h", "w", "2", "1", "1.90", "0.80"),
            _result("Mar 1, 2026", "Brighton", "a", "d", "1", "1", "1.10", "1.20"),
            _result("May 3, 2025", "Harbour City", "a", "l", "0", "1", "0.50", "1.00"),
            _result("Feb 9, 2026", "Ålesund Rovers", "h", "w", "4", "0", "3.00", "0.20"),
            _result("Jan 10, 2026", "Brighton", "h", "w", "2", "0", "", "0.70"),
            _result("Dec 1, 2025", "Ålesund Rovers", "a", "w", "3", "1", "2.00", "1.00"),
            _result("Mar 14, 2026", "Harbour City", "h", None, "", "", "", ""),
        ],
        "fixtures": [
            {"date": "May 10, 2026", "time": "15:00", "opponent": "Brighton", "side": "h"},
            {"date": "May 3, 2026", "time": "17:30", "opponent": "Harbour City", "side": "a"},
            {"date": "May 3, 2026", "time": "17:30", "opponent": "Harbour City", "side": "a"},
        ],
        "statistics": [_stat("Open play", "120", "15", "14.20", "0.12"), _stat("Set piece", "30", "4", "3.10", "0.10")],
        "roster": [{"Player": "Ayo Ràmos", "Player_URL": "p/1"}, {"Player": "Staff Member", "Player_URL": None}],
    },
    "harbour_city": {
        "team_name": "Harbour City", "url": "u2",
        "results": [
            _result("Sep 29, 2025", "Northside", "a", "l", "1", "2", "0.80", "1.90"),
            _result("May 3, 2025", "Northside", "h", "w", "1", "0", "1.00", "0.50"),
        ],
        "fixtures": [{"date": "May 3, 2026", "time": "17:30", "opponent": "Northside", "side": "h"}],
        "statistics": [_stat("Open play", "100", "12", "13.00", "0.13")],
        "roster": [],
    },
    "brighton": {
        "team_name": "Brighton", "url": "u3",
        "results": [_result("Mar 1, 2026", "Northside", "h", "d", "1", "1", "1.20", "1.10")],
        "fixtures": [],
        "statistics": [_stat("Open play", "90", "10", "9.50", "0.11")],
        "roster": [],
    },
}


def _season(n, season, team, apps, mins, g, a, sh90, kp90, xg, xa):
    return {"№": n, "Season": season, "Team": team, "Apps": apps, "Min": mins, "G": g, "A": a, "Sh90": sh90,
            "KP90": kp90, "xG": xg, "xA": xa, "xG90": "", "xA90": ""}


def _pmatch(date, home, score, away, pos, mins, sh, g, kp, a, xg, xa):
    return {"№": "1", "Date": date, "Home": home, "Score": score, "Away": away, "Pos": pos, "Min": mins,
            "Sh": sh, "G": g, "KP": kp, "A": a, "xG": xg, "xA": xa}


PLAYERS = {
    "ayo_ramos": {
        "player_name": "Ayo Ràmos", "player_url": "p/1",
        "seasonal_performance": [
            _season("1", "2025/2026", "Northside", "11", "900", "7", "2", "2.10", "1.00", "6.10", "1.90"),
            _season("2", "2025/2026", "Harbour City", "2", "45", "0", "0", "180.00", "0.00", "0.10", "0.00"),
            _season("", "", "", "13", "945", "7", "2", "", "", "6.20", "1.90"),
        ],
        "match_performance": [
            _pmatch("2025-09-29", "Northside", "2-1", "Harbour City", "FW", "90", "4", "2", "1", "0", "1.50", "0.20"),
            _pmatch("2026-03-01", "Brighton", "1-1", "Northside", "FW", "80", "3", "1", "2", "0", "0.70", "0.10"),
            _pmatch("2026-03-01", "Brighton", "1-1", "Northside", "FW", "80", "3", "1", "2", "0", "0.70", "0.10"),
            _pmatch("2025-05-03", "Harbour City", "1-0", "Northside", "FW", "60", "1", "0", "0", "0", "", ""),
            _pmatch("", "", "", "", "", "", "", "", "", "", "", ""),
        ],
    },
    "ben_oduya": {
        "player_name": "Ben Oduya", "player_url": "p/2",
        "seasonal_performance": [],
        "match_performance": [
            _pmatch("2026-02-09", "Northside", "4-0", "Ålesund Rovers", "DF", "90", "0", "0", "1", "1", "", "0.30"),
            _pmatch("2026-01-10", "Northside", "2-0", "Brighton", "DF", "12.5", "0", "0", "0", "0", "0.05", "0.00"),
        ],
    },
    "carl_sub": {
        "player_name": "Carl Sub", "player_url": "p/3",
        "seasonal_performance": [],
        "match_performance": [
            _pmatch("2026-02-09", "Northside", "4-0", "Ålesund Rovers", "MF", "0", "0", "0", "0", "0", "", ""),
        ],
    },
}


def write_bronze(root: str, two_loads: bool = True) -> str:
    """Write the fixture bronze tree under `root`; returns the bronze root."""
    b = os.path.join(root, "bronze")
    if two_loads:
        _write(f"{b}/league/load_date=2026-03-14/standings.json", {"data": LEAGUE_OLD, "_metadata": STAMP_1})
        _write(f"{b}/teams/load_date=2026-03-14/northside.json",
               {**TEAMS["northside"], "results": TEAMS["northside"]["results"][:2], "_metadata": STAMP_1})
        _write(f"{b}/players/load_date=2026-03-14/ayo_ramos.json",
               {**PLAYERS["ayo_ramos"], "match_performance": [], "_metadata": STAMP_1})
    _write(f"{b}/league/load_date=2026-03-21/standings.json", {"data": LEAGUE_NEW, "_metadata": STAMP_2})
    for k, doc in TEAMS.items():
        _write(f"{b}/teams/load_date=2026-03-21/{k}.json", {**doc, "_metadata": STAMP_2})
    for k, doc in PLAYERS.items():
        _write(f"{b}/players/load_date=2026-03-21/{k}.json", {**doc, "_metadata": STAMP_2})
    return b


BADGES = [
    {"team": "Northside FC", "badge_url": "b/north.png"},
    {"team": "Harbour City", "badge_url": "b/harbour.png"},
    {"team": "Brighton and Hove Albion", "badge_url": "b/brighton.png"},
    {"team": "Alesund Rovers", "badge_url": "b/alesund.png"},
]

PROFILES = [
    {"name": "Ayo Ramos", "club": "Northside", "position": "FW", "nationality": "ES", "image_url": "i/40x40/1.png"},
    {"name": "Benn Oduya", "club": "Northside", "position": "DF", "nationality": "KE", "image_url": None},
    {"name": "Someone Else", "club": "Brighton", "position": "MF", "nationality": "GB", "image_url": "i/3.png"},
]
