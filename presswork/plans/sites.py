"""The built-in sites and the rules for every other host."""

from __future__ import annotations

from presswork.functions.html import tag_where
from presswork.plans.rules import ANY_HOST, Image, Site, Title


def _each(kind: str, *picks: str) -> tuple[Title, ...]:
    """One step per pick: an empty or rejected text moves on to the next."""
    return tuple(Title(kind, (p,)) for p in picks)


def _images(*picks: str, attrs: tuple[str, ...] = ("data-src", "data-lazy-src", "src"),
            reject: str = "") -> tuple[Image, ...]:
    """One step per pick; ``meta`` tags carry the URL in their content."""
    return tuple(
        Image((p,), ("content",) if p.startswith("meta") else attrs, reject=reject) for p in picks)


# Selectors, wordings, paths and default URLs of each site, in the
# order in which they are tried.
OG_TITLE = ("meta[property='og:title']", "meta[name='twitter:title']")
OG_IMAGE = ("meta[property='og:image']", "meta[name='twitter:image']")
RASTER = r"[.]jpg|[.]png|[.]webp"
NO_LOGO = r"[.]svg|logo"
NO_AUTHOR = r"[.]svg|logo|author|bio|w=90"
_CHROME = "(?:nav|header|footer|menu)"
BODY_BUT_NOT_CHROME = tag_where(
    "div", "class", rf"""(?!(?:[^"]*\s)?{_CHROME}[\s"])[^"]*body[^"]*""", rf"""(?!(?:[^']*\s)?{_CHROME}[\s'])[^']*body[^']*""",
    rf"""(?!{_CHROME}[\s>])[^\s"'>]*body[^\s>]*""")
IGN_ATTRS = ("data-src", "srcset", "src")

SITES: dict[str, Site] = {
    "ign": Site(
        name="IGN", base="https://www.ign.com",
        titles=(Title("text", ("h1.article-title", "h1.display-title")),),
        images=(
            *_images("div.article-header img", "div.article-lead-image-wrap img", "figure.article-image img",
                     *OG_IMAGE, "div.jsx-3553238252 img", "div.article-page img", "picture img", attrs=IGN_ATTRS),
            Image(("div.jsx-3553238252 picture source",), ("srcset",)),
            Image(("img",), IGN_ATTRS, accept=RASTER, every=True)),
        default_image="https://assets-prd.ignimgs.com/2023/09/20/ign-default-1695238495427.jpg",
        noise=("div.ad-wrap", "div.widget", "div.sidebar", "script", "style"),
        containers=("div.article-content", "div.article-page"), one_container=True, min_paragraphs=0,
        names_itself=False, gated=False,
        paths=("/news",), items=("div.content-item",), distinct_links=False),
    "pcgamer": Site(
        name="PC Gamer", base="https://www.pcgamer.com",
        titles=(Title("text", ("h1.article-name", "h1.article-title", "h1")),),
        images=(
            *_images("figure.lead-image img", "div.image-wrap img", "picture img", "meta[property='og:image']",
                     "div.article-hero img", "div.featured-image img"),
            Image(("img",), accept=RASTER, every=True, add_https=True)),
        default_image="https://cdn.mos.cms.futurecdn.net/6bxva8DmZvNj8kaVrQZZMP-970-80.jpg",
        noise=("div.ad-container", "div.related-articles", "div.buying-guide", "script", "style"),
        containers=("div#article-body",), one_container=True, min_paragraphs=0, names_itself=False,
        paths=("/news",), items=("div.listingResult",), links=("a.article-link",), distinct_links=False),
    "gamespot": Site(
        name="GameSpot", base="https://www.gamespot.com",
        titles=(Title("text", ("h1",)),),
        images=(Image(("img.article-image", "picture img", "img[src*='gamespot']"), ("src", "data-src")),),
        noise=("div.ad-wrap", "div.mapped-ad", "div[class*='ad']", "nav", "header", "footer", "script", "style"),
        containers=("div.article-body", "div.js-content-entity-body", "section.content-body",
                    "div[data-id='article-body']", BODY_BUT_NOT_CHROME),
        one_container=True,
        wide_containers=("div.article-body", "div.js-content-entity-body", "section.content-body",
                         "div[data-id='article-body']", BODY_BUT_NOT_CHROME),
        wide_tags="p|h2|h3|li|span", wide_min=20, names_itself=False,
        paths=("/news",),
        items=("a.card-item__link", "a[data-event-tracking='Thumb Click']", "a[href*='/articles/']")),
    "eurogamer": Site(
        name="Eurogamer", base="https://www.eurogamer.net",
        titles=(Title("text", ("h1", "h1.article__title", "h1.title", "header h1")),), slug=True,
        images=(
            *_images("figure img", "picture img", "img[src*='eurogamer']", "img.lead", "img.article__image",
                     "div.article__image-container img"),
            Image(("img",), accept="eurogamer|/images/", every=True)),
        noise=("aside", "div.ad", "div.newsletter", "div.comments", "div.social", "nav", "script", "style"),
        containers=("div[class*='article__body']", "div.article__content", "div.content", "article",
                    "div.article-body"),
        wide_containers=("main", "article", "div.article"),
        paths=("/news", "/", "/articles", "/reviews"),
        items=("a[href*='/news/']", "a[href*='/articles/']", "div.article a", "h2 a", "article a",
               "a.article-link"),
        must_contain="/news/|/articles/",
        known_links=(
            "https://www.eurogamer.net/prime-gaming-members-get-22-more-games-in-may",
            "https://www.eurogamer.net/amidst-layoffs-apex-legends-announces-new-season-25-legend-sparrow-and-return-of-arenas-1",
            "https://www.eurogamer.net/confirmed-xbox-console-prices-are-going-up-worldwide",
            "https://www.eurogamer.net/super-mario-wonder-captain-toad-and-wario-sets-join-nintendo-lego-range",
            "https://www.eurogamer.net/evil-dead-the-game-disappears-from-sale-after-three-years")),
    "gamerant": Site(
        name="GameRant", base="https://gamerant.com",
        titles=(Title("meta", OG_TITLE),
                *_each("text", "h1.title", "h1.entry-title", "h1.article-title", "h1", "header h1",
                       ".article-title")),
        own_names=("game rant", "gamerant"), slug=True,
        images=(
            Image(OG_IMAGE, ("content",), reject=NO_AUTHOR),
            *_images("div.header-img img", "figure.wp-block-image img", "div.featured-image img",
                     "img.wp-post-image", "picture img", "div.article-featured-image img",
                     "div.article-img img", "div.article-header img", "div.article-hero img",
                     "div.entry-image img", "div.browse-clip-img img", "div.image-wrapper img",
                     "div.lead-image img", "div.lead-img img", reject=NO_AUTHOR),
            Image(("div.article-body img", "div.entry-content img", "article img"), reject=NO_LOGO,
                  every=True, in_scope=True),
            Image(("img",), accept="wp-content/uploads|gamerantimages", reject=NO_LOGO, every=True)),
        noise=("div.related-article", "div.affiliate-disclaimer", "div.newsletter", "div.comments", "div.tags",
               "div.social", "nav", "aside", "script", "style"),
        containers=("div.article-body", "div.entry-content", "div.content-area", "article",
                    "div[class*='article'] div[class*='content']"),
        wide_containers=("main", "article", "div.content"),
        paths=("/gaming", "/", "/news", "/game-news"),
        items=("article.browse-clip", "article", "div.article-card", "div.card", "a[href*='/game-']",
               "a[href*='/gaming/']", "a.article-link"),
        links=("a.bc-title-link", "a.title", "a[class*='title']", "a"),
        known_links=(
            "https://gamerant.com/best-rpgs-2024/",
            "https://gamerant.com/xbox-price-increase-2024/",
            "https://gamerant.com/nintendo-switch-2-games-price-increase/",
            "https://gamerant.com/elden-ring-shadow-of-the-erdtree-dlc-release-date-trailer/",
            "https://gamerant.com/call-of-duty-black-ops-6-release-date-trailer/")),
    "polygon": Site(
        name="Polygon", base="https://www.polygon.com",
        titles=(Title("text", ("h1.c-page-title", "h1.p-entry-title", "h1.c-entry-title", "h1")),), slug=True,
        images=(
            *_images("div.c-entry-hero img", "figure.e-image img", "div.c-picture img", "img.c-picture__image",
                     "picture img", "img[data-chorus-optimize-field='main_image']"),
            Image(("img",), accept="polygon|/uploads/", every=True)),
        noise=("aside", "div.c-related-list", "div.c-newsletter", "div.c-comments", "div.c-tags", "div.c-social",
               "nav", "script", "style"),
        containers=("div.c-entry-content", "div.entry-content", "article", "div.c-entry"),
        wide_containers=("main", "article", "div.l-wrapper"),
        paths=("/news", "/", "/gaming", "/games"),
        items=("div.c-entry-box--compact", "article", "div.c-entry-box", "div.c-compact-river__entry",
               "div.l-hero", "div.c-entry-box--compact--article", "a[data-analytics-link='article']"),
        links=("h2.c-entry-box--compact__title a", "h2 a", "a.c-entry-box--compact__image-wrapper",
               "a[href*='/20']", "a"),
        known_links=(
            "https://www.polygon.com/gaming/567454/blizzard-diablo-4-immortal-berserk-crossover-interview-lead-artists",
            "https://www.polygon.com/what-to-play/24151983/best-cozy-games-play-nintendo-switch-steam-playstation-xbox-pc",
            "https://www.polygon.com/gaming/582474/zelda-breath-of-the-wild-switch-2-speedrun",
            "https://www.polygon.com/news/576255/fortnite-ios-app-store-return-court-ruling",
            "https://www.polygon.com/gaming/564148/best-new-game-releases-may-2025")),
    "kotaku": Site(
        name="Kotaku", base="https://kotaku.com",
        titles=(Title("text", ("h1.sc-1efpnfq-0",)),),
        images=(Image(("div.sc-1i9kpqh-0 img", "picture img"), ("src",)),),
        noise=("aside", "div.ad-container", "script", "style"),
        containers=("div.sc-r43lxo-1",), one_container=True, min_paragraphs=0, names_itself=False,
        paths=("",), items=("article.js_post_item",), links=("a.js_link",), distinct_links=False),
    "wccftech": Site(
        name="WCCFTech", base="https://wccftech.com",
        titles=(Title("text", ("h1.entry-title", "h1.title", "h1.post-title", "h1")),), slug=True,
        images=(
            *_images("div.entry-content img", "div.featured-image img", "div.post-thumbnail img",
                     "img.wp-post-image", "picture img", "div.featured img"),
            Image(("img",), accept="wccftech|/wp-content/", every=True)),
        noise=("div.code-block", "div.wp-block-embed", "div.related-posts", "div.newsletter", "div.comments",
               "div.tags", "div.social", "nav", "script", "style"),
        containers=("div.entry-content", "div.post-content", "div.article-content", "article", "div.content"),
        wide_containers=("main", "article", "div.post"),
        paths=("/topic/games", "/", "/category/games", "/news"),
        items=("article.post", "article", "div.post", "div.article", "div.news-item", "div.entry"),
        links=("h2.entry-title a", "h2 a", "h3 a", "a.title", "a[href*='/20']"),
        known_links=(
            "https://wccftech.com/xbox-price-increase-2024-series-x-s-games-accessories/",
            "https://wccftech.com/nintendo-switch-2-games-price-increase/",
            "https://wccftech.com/elden-ring-shadow-of-the-erdtree-release-date-trailer/",
            "https://wccftech.com/call-of-duty-black-ops-6-release-date-trailer/",
            "https://wccftech.com/gta-6-release-date-trailer/")),
    "thegamer": Site(
        name="TheGamer", base="https://www.thegamer.com",
        titles=(Title("meta", OG_TITLE), Title("page", ("title",)),
                *_each("text", "h1.title", "h1.article-title", "h1.entry-title", "h1", "header h1",
                       ".article-title", ".post-title", "article h1"),
                Title("jsonld")),
        own_names=("thegamer", "the gamer"), slug=True,
        images=(
            *_images("div.image-holder img", "figure.wp-block-image img", "div.featured-image img",
                     "img.wp-post-image", "picture img", "div.article-image img", "meta[property='og:image']",
                     "div.post-thumbnail img", "img.attachment-large", reject=NO_LOGO),
            Image(("img",), accept=RASTER, reject=NO_LOGO, every=True)),
        default_image="https://static0.thegamerimages.com/wordpress/wp-content/uploads/2023/05/thegamer-default-og-1.jpg",
        noise=("div.related-article", "div.ad-unit", "div.newsletter", "div.comments", "div.social", "nav",
               "script", "style"),
        containers=("div.article-body", "div.entry-content", "div.article-content", "article", "div.content"),
        wide_containers=("main", "article", "div.article"),
        paths=("/category/game-news", "/gaming", "/games", "/news", "/"),
        items=("article.list-item", "article", "div.article", "div.post", "div.entry", "div.card"),
        links=("a.article-link", "h2 a", "h3 a", "a.title", "a[href*='/20']", "a"),
        must_not_contain="/tag/|/author/",
        known_links=(
            "https://www.thegamer.com/elden-ring-shadow-of-the-erdtree-release-date-trailer/",
            "https://www.thegamer.com/gta-6-release-date-trailer/",
            "https://www.thegamer.com/call-of-duty-black-ops-6-release-date-trailer/",
            "https://www.thegamer.com/nintendo-switch-2-release-date-news/",
            "https://www.thegamer.com/xbox-series-x-price-increase/")),
    "engadget": Site(
        name="Engadget", base="https://www.engadget.com",
        titles=(Title("text", ("h1.t-h4", "h1.article-title", "h1.entry-title", "h1")),), slug=True,
        slug_drops_html=True,
        images=(
            *_images("div.t-article-image img", "div.article-image img", "div.featured-image img",
                     "img.wp-post-image", "picture img", "div.article-image-wrapper img", "img.c-picture__image",
                     "meta[property='og:image']"),
            Image(("img",), accept="engadget|[.]jpg|[.]png", every=True)),
        images_absolute=True,
        default_image="https://s.yimg.com/os/creatr-uploaded-images/2020-10/fe92d4b0-0f9c-11eb-bfce-a5570d2300c0",
        noise=("div.t-d-module", "div.t-galleria", "div.related-posts", "div.newsletter", "div.comments",
               "div.social", "nav", "script", "style"),
        containers=("div.t-article-content", "div.article-content", "div.entry-content", "article",
                    "div.content"),
        wide_containers=("main", "article", "div.article"),
        paths=("/gaming", "/games", "/news", "/", "/tag/gaming"),
        items=("div.o-hit", "article", "div.article", "div.post", "div.c-entry", "div.card"),
        links=("a.o-hit__link", "h2 a", "h3 a", "a.article-link", "a[href*='/20']", "a"),
        must_not_contain="/tag/|/author/",
        known_links=(
            "https://www.engadget.com/gaming/epic-games-takes-aim-at-apple-and-steam-with-zero-commission-policy-for-developers-183956940.html",
            "https://www.engadget.com/gaming/nintendo/nintendo-switch-2-pre-orders-latest-updates-console-remains-sold-out-at-gamestop-walmart-target-best-buy-and-others-140931858.html",
            "https://www.engadget.com/gaming/microsoft-is-raising-prices-on-the-xbox-series-s-and-series-x-132004594.html",
            "https://www.engadget.com/gaming/call-of-duty-black-ops-6-release-date-trailer-142538921.html",
            "https://www.engadget.com/gaming/elden-ring-shadow-of-the-erdtree-release-date-trailer-164512834.html")),
}

# Any host without rules of its own: heading, page title or slug; the first
# article element; no check of title and image.
OTHER_HOSTS = Site(
    name="", base="", host=ANY_HOST,
    titles=(Title("text", ("h1",)), Title("page", ("title",))), slug=True,
    images=(Image(OG_IMAGE, ("content",)), Image(("img",), every=True)),
    noise=("script", "style", "nav", "aside", "header", "footer"),
    containers=("article",), wide_containers=("article", "main", "body"),
    names_itself=False, gated=False,
    items=("a",))
