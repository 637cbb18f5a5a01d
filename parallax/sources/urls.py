"""Addresses of pages and documents, as expressions, and the joins from addresses to cached pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.sources.tables import page_key


@dataclass(frozen=True)
class Sites:
    """Where pages and documents are; fixed values of the public sites."""

    pages: str = "https://www.baseball-reference.com"
    documents: str = "https://statsapi.mlb.com/api/v1"
    league_code: str = "KBO"

    def league_index(self) -> Column:
        return F.lit(f"{self.pages}/register/league.cgi?code={self.league_code}&class=Fgn")

    def season(self, season_id: Column) -> Column:
        return F.concat(F.lit(f"{self.pages}/register/league.cgi?id="), season_id)

    def team(self, team_id: Column) -> Column:
        return F.concat(F.lit(f"{self.pages}/register/team.cgi?id="), team_id)

    def player(self, player_id: Column) -> Column:
        return F.concat(F.lit(f"{self.pages}/players/"), F.substring(player_id, 1, 1), F.lit("/"), player_id, F.lit(".shtml"))

    def league(self, year: Column, side: str) -> Column:
        return F.concat(F.lit(f"{self.pages}/leagues/majors/"), year.cast("string"), F.lit(f"-standard-{side}.shtml"))

    def player_stats(self, player_id: Column, side: str) -> Column:
        group = {"batting": "hitting", "pitching": "pitching"}[side]
        return F.concat(F.lit(f"{self.documents}/people/"), player_id.cast("string"), F.lit(f"/stats?stats=yearByYear&group={group}"))

    def team_stats(self, year: Column, side: str) -> Column:
        group = {"batting": "hitting", "pitching": "pitching"}[side]
        return F.concat(F.lit(f"{self.documents}/teams/stats?season="), year.cast("string"), F.lit(f"&sportIds=1&group={group}&stats=season"))


def with_pages(rows: DataFrame, url: Column, pages: DataFrame) -> DataFrame:
    """``rows`` with the html of their addresses from the cache (page, html); rows without a page are left out."""
    return rows.withColumn("page", page_key(url)).join(pages, "page").drop("page")
