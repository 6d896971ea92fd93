"""Static description of every audit rule, in our own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# rule id, stage, severity, least hits, owner, effort, evidence, what is counted, why, fix
_ROWS = """
robots-missing|eligibility|Low|1|dev|S|observed|site(s) without a usable robots.txt|A missing file allows everything; a server error can pause crawling of the host.|Serve robots.txt with status 200 and name the sitemap in it.
robots-disallow-all|eligibility|Critical|1|dev|S|observed|robots rule(s) that disallow the whole site|Crawlers that obey the rule fetch nothing.|Delete the blanket disallow rule and confirm the file was fetched again.
robots-blocked-assets|eligibility|High|1|dev|S|observed|robots rule(s) that block styles or scripts|Pages are rendered before they are judged, and blocked assets break the rendering.|Allow every asset folder the templates load from.
noindex-disallow-trap|eligibility|High|1|dev|S|observed|page(s) with noindex that robots.txt also blocks|The directive is never read because the page may not be fetched.|Keep one of the two: lift the block to deindex, lift both to index.
noindex-present|eligibility|High|1|dev|S|observed|page(s) with noindex that look worth indexing|A page with noindex cannot appear in results.|Remove the directive from the markup, the header and the site-wide setting.
broken-links|eligibility|High|1|dev|M|observed|internal URL(s) that return an error|Links to errors waste fetches and strand readers.|Repair each URL, redirect it to its closest successor, or remove the links.
redirect-chains|eligibility|Medium|1|dev|M|observed|URL(s) that redirect more than once|Each extra hop costs time and a little signal.|Point every rule straight at the final address.
internal-links-to-redirects|eligibility|Low|4|dev|M|observed|internal link(s) that point at a redirect|The redirect becomes load bearing and costs a fetch per visit.|Edit the links to use the final address.
mixed-content|eligibility|Medium|1|dev|S|observed|https page(s) that load http resources|Browsers block or downgrade such resources.|Rewrite the references to https.
no-https|eligibility|Critical|1|dev|M|observed|site(s) served over plain http|Browsers flag the site and forms as not secure.|Install a certificate and redirect every http address once.
soft-404|eligibility|High|1|dev|M|observed|page(s) that say not found with status 200|Empty pages with a success status cost crawl budget and trust.|Return a real 404 or 410, or redirect to a true equivalent.
canonical-missing|indexation|Medium|1|dev|S|observed|indexable page(s) without a canonical|The engine then picks one of the variants itself.|Emit one absolute self-referencing canonical per page.
canonical-cross|indexation|Medium|1|dev|M|observed|page(s) whose canonical names another URL|A canonical to a redirect, error or noindex page is ignored.|Check that each target is a live indexable page, else make the tag self-referencing.
canonical-conflict|indexation|High|1|dev|M|observed|page(s) with several different canonicals|Conflicting canonicals are all ignored.|Find the second emitter and remove it.
duplicate-content|indexation|High|1|dev|M|observed|set(s) of URLs with identical content|One of the copies is chosen and the rest lose their signals.|Choose one URL per set and redirect or canonicalise the others to it.
near-duplicate|indexation|Medium|1|content|L|observed|pair(s) of nearly identical contents|Near copies compete with each other for the same query.|Merge them or make each one genuinely different.
url-variants|indexation|Medium|1|dev|M|observed|address(es) reachable in more than one form|Every form counts as its own page and splits the signals.|Pick one form and redirect the rest at the server.
sitemap-dirty|indexation|Medium|1|dev|S|observed|sitemap URL(s) that are not canonical indexable pages|Contradicting the sitemap with page signals weakens both.|Generate the sitemap from canonical pages that return 200.
sitemap-lastmod|indexation|Low|1|dev|S|observed|sitemap(s) whose entries share one or two dates|A date that always changes together carries no information.|Write each page's own modification date or none.
sitemap-incomplete|indexation|Low|3|dev|S|observed|indexable page(s) missing from the sitemap|Discovery of weakly linked pages is slower.|Include these page types in the sitemap.
sitemap-absent|indexation|Medium|1|dev|S|observed|site(s) without an XML sitemap|Discovery then depends on links alone.|Generate a sitemap and name it in robots.txt.
index-bloat|indexation|Medium|4|dev|S|observed|low-value URL(s) open to indexing|Archives and search pages dilute the site and use crawl budget.|Set noindex on them and leave them crawlable.
click-depth|linking|Medium|1|dev|M|observed|page(s) more than three clicks from the start|Deep pages receive little internal signal.|Link to them from hubs or related pages.
orphans-unknown|linking|Medium|1|SEO|S|observed|crawl(s) too short to judge internal linking|On a partial crawl an unvisited page looks like an orphan.|Raise the page cap or scope the crawl to one section.
orphans|linking|High|1|dev|M|observed|page(s) that no internal link points at|Such pages are found only through the sitemap and rarely rank.|Link to each from a relevant page.
nav-only-links|linking|Medium|3|content|M|observed|page(s) linked only from navigation or footer|Site-wide links carry little weight.|Add links in running text with descriptive anchors.
generic-anchors|linking|Low|5|content|M|observed|body link(s) with anchors that say nothing|The anchor is a relevance signal left unused.|Rewrite the anchors to name the destination.
breadcrumbs-missing|schema|Low|4|dev|S|observed|deep page(s) without breadcrumb markup|Breadcrumbs replace the bare URL in a result.|Emit BreadcrumbList from the URL hierarchy.
title-missing|onpage|High|1|content|S|observed|page(s) without a title|The title is the headline of the result.|Write a unique title that leads with the main term.
title-duplicate|onpage|High|1|content|M|observed|title(s) used on more than one page|Equal titles make pages compete.|Name what is unique about each page.
title-length|onpage|Low|1|content|S|observed|title(s) wider than the result allows|The end of the title is cut off.|Move the distinguishing words to the front.
title-h1-mismatch|onpage|Medium|3|content|M|observed|page(s) whose title and H1 disagree|A contradiction invites a rewritten headline.|Align both on one main term.
h1-missing|onpage|Medium|1|dev|S|observed|page(s) without an H1|The page lacks a statement of its subject.|Set the main heading as the only H1.
h1-multiple|onpage|Low|1|dev|S|observed|page(s) with several H1 headings|Several main headings blur the subject.|Keep one H1 and demote the rest.
heading-skips|onpage|Low|3|dev|M|observed|page(s) that skip heading levels|The outline becomes ambiguous for parsers and screen readers.|Choose levels by outline, not by size.
meta-missing|onpage|Low|1|content|M|observed|page(s) without a description|The snippet is then taken from anywhere on the page.|Write one for every page that matters.
meta-duplicate|onpage|Low|1|content|M|observed|description(s) used on more than one page|A repeated description is usually discarded.|Write them per page.
thin-content|onpage|Medium|1|content|L|observed|page(s) with very little text|Short pages often leave the query's questions open.|Cover the subtopics of the query, answer first.
img-alt|onpage|Low|1|content|M|observed|page(s) with images that have no alternative text|Readers of assistive technology and image search get nothing.|Describe each image; keep empty text for decoration only.
img-dimensions|performance|Low|3|dev|M|observed|page(s) with images of unknown size|The layout shifts when they load.|State width and height or an aspect ratio.
lazy-above-fold|performance|Medium|2|dev|S|observed|page(s) that lazy-load their first images|The largest paint waits for them.|Load the first images eagerly.
jsonld-invalid|schema|Medium|1|dev|S|observed|page(s) with structured data that does not parse|A broken block is dropped whole.|Fix the quoting and validate each block.
schema-absent|schema|Low|3|dev|M|observed|substantial page(s) without structured data|Rich results need it.|Add the types that match what the page shows.
eeat-author|onpage|Medium|3|content|L|observed|sensitive page(s) without a named author|Unattributed advice is ranked down.|Name a qualified author and link to a profile.
nap-inconsistent|offpage|Medium|3|SEO|M|observed|phone number(s) in use across the site|Inconsistent contact data weakens local trust.|Agree on one main number and match it to the listings.
js-dependency|performance|High|1|dev|L|observed|page(s) with hardly any content in the source|Content that appears only after scripts run may be missed.|Render the main content on the server.
viewport-missing|performance|Medium|1|dev|S|observed|page(s) without a viewport tag|Mobile rendering falls back to desktop width.|Add the viewport tag to the template.
lang-missing|onpage|Low|3|dev|S|observed|page(s) without a language|Pronunciation and targeting are left to guesswork.|Set the language on the html element.
slow-ttfb|performance|Low|3|dev|M|observed|page(s) that took over 1.5 seconds to respond|Response time bounds every later paint.|Check caching first, then the backend.
xrobots-noindex|eligibility|Critical|1|dev|M|observed|page(s) with noindex in a response header|The directive is invisible in the page source.|Find the server, edge or plugin rule that adds it.
xrobots-nofollow|linking|High|1|dev|S|observed|page(s) with nofollow in a response header|No link on these pages is followed.|Remove nofollow from the header.
canonical-header-conflict|indexation|High|1|dev|S|observed|page(s) whose header and markup name different canonicals|One of the two is picked, perhaps the wrong one.|Emit the canonical in one place only.
canonical-chain|indexation|High|1|dev|M|observed|canonical(s) that lead to another canonical|Chains of hints are not followed reliably.|Point each page at the final address.
pagination-canonical|indexation|High|1|dev|M|observed|paginated page(s) whose canonical is the first page|Later pages then count as copies and their links vanish.|Give each page of the series its own canonical.
hreflang-no-self|indexation|High|1|dev|M|observed|page(s) whose language set omits themselves|A set without a self reference is dropped.|List every page of the set on every page.
hreflang-no-return|indexation|High|1|dev|M|observed|language reference(s) that are not returned|Only mutual references count.|Generate the set from one shared list.
hreflang-bad-code|indexation|Medium|1|dev|S|observed|language code(s) that are not valid|Invalid codes are ignored.|Use a language code, optionally with a country code.
hreflang-no-xdefault|indexation|Low|1|dev|S|observed|site(s) whose language sets have no default|Visitors with no matching language get an arbitrary version.|Add x-default to the sets.
meta-refresh|eligibility|Medium|1|dev|S|observed|page(s) that redirect by meta refresh|It is slower and weaker than a server redirect.|Replace it with a single 301.
links-to-noindex|linking|Medium|1|SEO|M|inferred|page(s) linking to pages that cannot be indexed|Signal flows to pages that never rank.|Lift the noindex or drop the link from the navigation.
link-heavy|linking|Low|1|SEO|M|inferred|page(s) with more than 200 links|Each link shares the page's outgoing signal.|Trim menus and footers to what people use.
sitemap-nonindexable|indexation|Medium|1|dev|M|observed|sitemap URL(s) that cannot be indexed|The sitemap asks for pages the site withholds.|List canonical indexable URLs only.
sitemap-too-large|indexation|Medium|1|dev|M|observed|sitemap(s) above 50,000 URLs|Entries past the limit are not read.|Split it by section under an index.
param-crawl-trap|eligibility|Medium|1|dev|L|observed|parameter pattern(s) that multiply URLs|Combinations of filters use up the crawl budget.|Decide per parameter: canonical, block or keep.
render-blocking|performance|Medium|1|dev|M|observed|page(s) with more than six blocking resources|Nothing paints until they have loaded.|Inline critical styles and defer scripts.
font-display|performance|Low|1|dev|S|observed|page(s) with fonts that hide text while loading|Readers see blank text at first.|Set font-display on every face.
no-preconnect|performance|Low|1|dev|S|inferred|site(s) without any preconnect hint|Third-party connections start late.|Add hints for the few origins used above the fold.
"""

# acceptance criteria that differ from the general one
_ACCEPTANCE = {
    "noindex-present": "No listed URL carries noindex in markup or header.",
    "robots-disallow-all": "robots.txt returns 200 and no group disallows the root.",
    "broken-links": "Every listed URL returns 200 or one redirect to a 200.",
    "redirect-chains": "Every listed URL arrives in exactly one hop.",
    "canonical-missing": "Every indexable page has exactly one self-referencing canonical.",
    "title-duplicate": "No two indexable URLs share a title.",
    "h1-missing": "Every listed URL has exactly one H1.",
    "lazy-above-fold": "The first image of each template loads eagerly.",
    "img-dimensions": "Every image states its size or aspect ratio.",
}
_GENERAL = "The condition no longer holds on any listed URL after a new crawl."
COLUMNS = ["rule", "stage", "severity", "least", "owner", "effort", "evidence", "what", "why", "fix", "acceptance"]


def rows() -> list[tuple]:
    out = []
    for line in _ROWS.strip().splitlines():
        rule, stage, severity, least, owner, effort, evidence, what, why, fix = line.split("|")
        out.append((rule, stage, severity, int(least), owner, effort, evidence, what, why, fix,
                    _ACCEPTANCE.get(rule, _GENERAL)))
    return out


def rule_catalog(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    return spark.createDataFrame(
        rows() + list(extra),
        "rule string, stage string, severity string, least int, owner string, effort string, evidence string, "
        "what string, why string, fix string, acceptance string")
