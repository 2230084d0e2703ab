"""A small labelled URL table for the URL filter: invented hosts, by hand, and the rule that makes URLs of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names of hosts labelled by what their name says.
BAD = (
    "casino-royal lucky-casino casino24 mega-casino-slots slots-jackpot jackpot-city online-poker poker-bonus bets-today "
    "sports-bets bets365x quick-bets betting-odds free-spins roulette-win win-cash-now pills-online cheap-meds pharma-pills "
    "diet-pills-shop viagra-deal meds-without-rx adult-chat adult-videos xxx-tube hot-adult-cams sexy-dates nude-pics "
    "spam-mailer spam-blast bulk-spam link-farm farm-of-links seo-spam-tool ads-server ads-click popup-ads track-ads "
    "adserver-x clickbait-ads free-iphone-win warez-crack keygen-free torrent-crack payday-loan-fast replica-watches "
    "miracle-cure hack-password phish-login fake-bank-login").split()
GOOD = (
    "river-museum city-library weather-report green-garden school-board hillside-farmers university-press open-atlas "
    "daily-herald north-station history-notes baker-street mountain-guide cooking-class chess-club public-radio "
    "linen-thread orchard marble-works old-harbour sailing-club rail-timetable bird-watching star-charts town-hall "
    "lighthouse science-forum math-lessons poetry-corner film-archive music-school garden-plans bread-recipes tea-house "
    "theatre-bill stone-carving thin-ice other-shore nation-post station-house attention-lab motion-study herald-times "
    "instant-letters winter-tales think-tank thread-count ten-thousand-steps inn-on-the-hill tandem-rides ration-book "
    "entire-works ether-notes heron-lake anthill thanet-news rethink-design enter-here interior-plans tionale tin-roof").split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, bad): three URLs of each host, with the usual prefixes, endings and paths, which say nothing about the label."""
    rows = []
    for bad, names in ((True, BAD), (False, GOOD)):
        for n, name in enumerate(names):
            for k in range(3):
                prefix, ending = ("", "www.", "m.", "blog.")[(n + k) % 4], ("com", "net", "org")[(n + 2 * k) % 3]
                path = (f"/en/{(n * 37 + k * 911) % 9000}", f"/fr/{n}.html", f"/de/{k}?page={n}", "/es/", "/")[(n + k) % 5]
                rows.append((f"http://{prefix}{name}.example.{ending}{path}", bad))
    return spark.createDataFrame(rows, "url string, bad boolean")
