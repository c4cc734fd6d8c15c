import json
import os

from matchday import schemas
from matchday.operators.upsert import latest_version, read_latest
from matchday.plans import silver
from matchday.streaming.incremental import merge_new_loads

from . import fixtures


def test_new_loads_merged_once(spark, tmp_path):
    bronze = str(tmp_path / "bronze" / "league")
    table = str(tmp_path / "silver" / "league_standings")
    ckpt = str(tmp_path / "ckpt")

    def load(day, rows):
        d = f"{bronze}/load_date={day}"
        os.makedirs(d, exist_ok=True)
        stamp = {"extraction_timestamp": f"{day} 09:00:00", "load_date": day, "source": "test"}
        with open(f"{d}/standings.json", "w", encoding="utf-8") as f:
            json.dump({"data": rows, "_metadata": stamp}, f, ensure_ascii=False)

    def run():
        merge_new_loads(spark, bronze, schemas.LEAGUE_DOC, silver.league_standings, table,
                        schemas.KEYS["league_standings"], ckpt, "load_date", ["updated_at"])

    load("2026-03-14", fixtures.LEAGUE_OLD)
    run()
    assert latest_version(spark, table) == 0
    assert read_latest(spark, table).count() == 2
    run()  # nothing new: no new snapshot
    assert latest_version(spark, table) == 0
    load("2026-03-21", fixtures.LEAGUE_NEW)
    run()
    assert latest_version(spark, table) == 1
    rows = {r.team_name: r.points for r in read_latest(spark, table).collect()}
    assert len(rows) == 4 and rows["Northside"] == 23
