"""Small labelled table of invented URLs: 1 is to be blocked, 0 allowed.

Hosts and paths are made of common English words.  Every host stands in one
class only; some ordinary hosts have a page to be blocked, some hosts to be
blocked an ordinary page.
"""

_BAD = {
    "drugs": ["cheap-pills", "buy-viagra-now", "discount-meds", "online-pharmacy", "no-prescription-drugs", "cialis-store", "steroids-shop"],
    "gambling": ["best-casino-bonus", "free-slots-online", "win-big-jackpot", "poker-bonus", "bet-now-tips", "casino-royale-spins", "free-bets", "roulette-cash"],
    "adult": ["xxx-cams", "hot-singles", "adult-videos", "sex-chat", "nude-pics", "free-porn-tube", "escort-girls"],
    "money": ["payday-loans-fast", "quick-cash-loan", "crypto-doubler", "free-bitcoin-now", "get-rich-today", "easy-money-system", "forex-profit-robot"],
    "fakes": ["replica-watches", "fake-rolex-shop", "cheap-replica-bags", "torrent-cracks", "warez-keygen", "serial-number-crack", "counterfeit-brands"],
    "spam": ["seo-backlinks", "link-farm", "spam-farm", "spam-blast", "click-farm", "buy-followers-likes", "mass-mailer", "miracle-weight-loss", "diet-pills-free"],
}
_GOOD = (
    "harbor valley garden river museum library council weather recipes physics school journal maps history forum science books research parks music bakery clinic choir farm "
    "astronomy baking bicycle biology bridges canals carpentry castles chemistry chess cinema climate coffee compost dance desert dictionary drawing ecology engine essays "
    "fabric ferry fishing forest geology glacier grammar guitar hiking horses island kitchen knitting lake language law lighthouse linguistics literature mathematics meadow "
    "medicine memory mountain navy newspaper observatory ocean opera orchard painting paper philosophy photography piano planets poetry pottery printing railway "
    "robotics sailing sculpture sewing soccer statistics stories teaching theatre tides tools trains translation university village violin volcano walking water wildlife winter"
).split()
_BAD_PATHS = ["/buy-now", "/cheap/viagra", "/free-bonus/spin", "/xxx/videos", "/loans/apply-fast", "/casino/jackpot.html", "/pills?page=2", "/win/free-cash", "/adult/sex-videos", "/spam/backlinks.html"]
_GOOD_PATHS = ["", "/", "/about", "/articles/2021/05/garden", "/wiki/Main_Page", "/blog/post-12", "/library/catalogue", "/contact.html", "/news/today?page=3", "/a/b/c", "/guide#top", "/index.php?id=7"]
_PREFIXES = ["", "www.", "blog.", "m.", "news."]
_ENDS = ["com", "net", "org", "edu", "info"]


def _hosts(names: list[str]) -> list[str]:
    return [f"{_PREFIXES[(i + j) % 5]}{n}.{'example.' if (i + j) % 2 else ''}{_ENDS[(i + 2 * j) % 5]}" for i, n in enumerate(names) for j in range(2)]


BLOCK_HOSTS = _hosts([n for names in _BAD.values() for n in names])
ALLOW_HOSTS = _hosts(_GOOD)
LABELLED_URLS: list[tuple[str, int]] = (
    [(f"https://{h}{_BAD_PATHS[i % 10]}", 1) for i, h in enumerate(BLOCK_HOSTS)]
    + [(f"http://{h}{_GOOD_PATHS[(i + j) % 12]}", 1) for i, h in enumerate(BLOCK_HOSTS) for j in (0, 5)]
    + [(f"http://{h}{_GOOD_PATHS[i % 12]}", 0) for i, h in enumerate(ALLOW_HOSTS)]
    + [(f"https://{h}{_GOOD_PATHS[(i + 7) % 12]}", 0) for i, h in enumerate(ALLOW_HOSTS)]
    + [(f"https://{h}{_BAD_PATHS[i % 10]}", 1) for i, h in enumerate(ALLOW_HOSTS) if i % 6 == 0]
)
