"""Fixed values the analyses are defined by.

Everything in this file is a value that must be exactly as it is for results to
be right: patterns, word lists, thresholds and small lookup tables. No logic.
"""

# --- whitespace: the full Unicode set that ECMAScript's \s covers --------------
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# --- URLs -----------------------------------------------------------------------
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "_ga",
]
ASSET_URL = (
    r"(?i)\.(jpe?g|png|gif|webp|avif|svg|pdf|zip|mp4|mp3|css|js|ico|woff2?|xml|json|txt"
    r"|docx?|xlsx?|pptx?|csv|gz|tar|rar|7z|exe|dmg|apk)(\?|$)"
)
FEED_URL = r"(?i)/(feed|trackback|wp-json|comments/feed)(/|$)"
PAGED_URL = r"(?i)/(page|p)/(\d+)|[?&](page|paged)=\d+"
BLOAT_URL = r"(?i)/(tag|author|feed|search|page/\d+|attachment|wp-json|\?s=|category/uncategorized)"
ARTICLE_URL = r"(?i)/(blog|guide|guides|article|news|post)"
SLUG_NOISE = ["www", "com", "html", "php", "index", "page"]

# --- response headers kept from a fetch -------------------------------------------
KEPT_HEADERS = [
    "content-type", "x-robots-tag", "link", "cache-control", "content-encoding",
    "x-nitro-cache", "cf-cache-status", "vary", "age", "last-modified", "etag",
    "strict-transport-security", "content-security-policy",
    "content-security-policy-report-only", "x-frame-options",
    "x-content-type-options", "referrer-policy", "permissions-policy",
    "cross-origin-opener-policy", "cross-origin-resource-policy",
    "cross-origin-embedder-policy", "set-cookie",
    "server", "x-powered-by", "x-aspnet-version", "x-generator", "x-drupal-cache",
]
DISCLOSING_HEADERS = ["server", "x-powered-by", "x-aspnet-version", "x-generator", "x-drupal-cache"]

# (check id, header, weight)
HEADER_CHECKS = [
    ("hsts", "strict-transport-security", 18),
    ("csp", "content-security-policy", 20),
    ("xfo", "x-frame-options", 12),
    ("xcto", "x-content-type-options", 10),
    ("referrer", "referrer-policy", 8),
    ("permissions", "permissions-policy", 6),
    ("coop", "cross-origin-opener-policy", 5),
]
HSTS_MIN_AGE = 10368000
GRADE_FLOORS = [(90, "A"), (75, "B"), (60, "C"), (40, "D"), (20, "E")]

# --- page extraction ----------------------------------------------------------------
BOILERPLATE_TAGS = ["nav", "header", "footer", "script", "style", "noscript", "svg", "form", "aside"]
BOILERPLATE_ROLES = ["navigation", "banner", "contentinfo"]
MAIN_TAGS = ["main", "article"]
MAIN_CLASSES = ["entry-content", "site-main"]
ABOVE_FOLD_IMAGES = 3
MAX_INSECURE_REFS = 25
EMPTY_APP_ROOT = r"""(?i)<div[^>]+id=["'](root|app|__next)["'][^>]*>\s*</div>"""
INSECURE_REF = r"""(?i)(?:src|href)\s*=\s*["'](http://[^"']+)["']"""
META_REFRESH_TAG = r"""(?i)<meta[^>]+http-equiv\s*=\s*["']?refresh["']?[^>]*>"""
META_REFRESH_TARGET = r"""(?i)content\s*=\s*["']?\s*(\d+)\s*;\s*url\s*=\s*([^"'>]+)"""
HEADER_CANONICAL = r"""(?i)<([^>]+)>\s*;\s*rel\s*=\s*["']?canonical"""
PRECONNECT = r"""(?i)<link[^>]+rel=["']?(?:preconnect|dns-prefetch)["']?[^>]*href=["']([^"']+)"""
BLOCKING_STYLE = r"""(?i)<link[^>]+rel=["']?stylesheet["']?(?![^>]*media=["']?print)"""
BLOCKING_SCRIPT = r"""(?i)<script(?![^>]*\b(?:async|defer|type=["']?module)\b)[^>]+src="""
PHONE = r"(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
SHINGLE_WORDS, SHINGLE_STEP, SHINGLE_CAP = 5, 2, 400

# (label, literals searched in the lower-cased html)
HTML_LITERALS = [
    ("WordPress", ["wp-content", "wp-includes", "wp-json"]),
    ("Shopify", ["cdn.shopify.com", "shopify.theme", "shopify-features"]),
    ("Wix", ["wixstatic", "wix-code", "static.parastorage"]),
    ("Squarespace", ["squarespace.com", "sqsp.net", "static1.squarespace"]),
    ("Webflow", ["webflow.com", "webflow.io", "data-wf-page"]),
    ("Drupal", ["drupal-settings-json", "drupal.settings", "/sites/default/files"]),
    ("Joomla", ["/media/jui/", "joomla-script", "joomla!"]),
    ("Ghost", ["/ghost/api/", "ghost-sdk", "content_api_key"]),
    ("BigCommerce", []),
    ("Magento", ["mage-init", "magento_"]),
    ("WooCommerce", ["woocommerce"]),
    ("HubSpot", ["hs-scripts", "hubspot"]),
    ("Shopware", ["shopware"]),
    ("PrestaShop", ["prestashop"]),
    ("Next.js", []),
    ("Nuxt", []),
    ("Angular", ["ng-version="]),
    ("Gatsby", ["gatsby-", "___gatsby"]),
    ("SvelteKit", ["data-svelte", "__sveltekit"]),
    ("Astro", ["astro-island", "data-astro"]),
    ("React", ["data-reactroot", "react-dom", "_reactlistening"]),
    ("Vue", ["data-v-app", "__vue__"]),
    ("Elementor", ["elementor"]),
    ("Genesis", ["/themes/genesis", "genesis_", "studiopress"]),
    ("WPBakery", ["wpbakery", "js_composer"]),
    ("Divi", []),
    ("Yoast SEO", ["yoast"]),
    ("Rank Math", ["rank-math", "rankmath"]),
    ("NitroPack", ["nitropack", "nitro-"]),
]
# (label, literal that must be in the lower-cased html, pattern over the html itself)
HTML_PATTERNS = {
    "BigCommerce": ("bigcommerce", r"(?i)cdn\d*\.bigcommerce"),
    "Magento": ("static/version", r"(?i)static/version\d"),
    "WPBakery": ("vc_row", r"(?i)\bvc_row\b"),
}
# literals searched in the html as it is
HTML_CASED_LITERALS = {
    "Next.js": ["__NEXT_DATA__", "_next/static"],
    "Nuxt": ["__NUXT__", "_nuxt/"],
    "Divi": ["et_pb_", "et_divi", "/themes/Divi", "/themes/divi", "divi-builder"],
}
# (label, pattern over "name: value" header lines)
HEADER_FINGERPRINTS = [
    ("NitroPack", r"(?im)^x-nitro-cache: ."),
    ("WP Engine", r"(?i)wpengine"),
    ("Cloudflare", r"(?im)^[^:]*cf-ray[^:]*:"),
    ("Vercel", r"(?i)x-vercel-id"),
    ("Netlify", r"(?i)x-nf-request-id"),
    ("Fastly", r"(?i)fastly"),
    ("CloudFront", r"(?i)x-amz-cf-id"),
]

# glyph classes of the result-page font, as hundredths of the font size
NARROW_CHARS, NARROW_W = "ijlt.,;:!|'\"()[]{}/\\ ", 28
WIDE_CHARS, WIDE_W = "mwMW@%", 85
UPPER_CHARS, UPPER_W = "ABCDEFGHIJKLNOPQRSTUVXYZ", 62
DIGIT_CHARS, DIGIT_W = "0123456789", 55
OTHER_W = 50
TITLE_MAX_PX, TITLE_MIN_PX, META_MAX_PX, META_MAX_CHARS = 580, 285, 920, 155
# Fixes: H2s short enough for a title, sentences and drafts long enough for a
# description, leads wide enough alone, texts that are articles, headline length.
TITLE_SECOND_CHARS, META_SENTENCE_CHARS, META_MIN_CHARS, META_LEAD_PX, ARTICLE_WORDS, HEADLINE_CHARS = 46, 25, 50, 400, 900, 110

# sections named in a site's profile
PROFILE_SECTIONS = 12

# --- audit rules -----------------------------------------------------------------------
STAGES = ["eligibility", "indexation", "intent", "onpage", "linking", "schema", "performance", "offpage"]
STAGE_RANK = {
    "eligibility": 1, "indexation": 2, "intent": 3, "onpage": 4,
    "linking": 5, "schema": 6, "performance": 7, "offpage": 8,
}
SEVERITIES = ["Critical", "High", "Medium", "Low"]
EFFORT_POINTS = {"S": 1, "M": 3, "L": 8}
YMYL = (
    r"(?i)\b(lawyer|attorney|legal|law|injury|malpractice|medical|doctor|health|clinic|insurance"
    r"|loan|mortgage|tax|financial|invest|billing|claim)\b"
)
GENERIC_ANCHOR = (
    r"(?i)^(click here|read more|learn more|more|here|this|link|continue|see more|view|details"
    r"|read on|find out more)\.?$"
)
SOFT_404 = r"(?i)\b(not found|no results|nothing found|page (doesn'?t|does not) exist|404)\b"
BLOCKED_ASSET_RULE = r"(?i)\.(css|js)|/wp-includes|/wp-content/(themes|plugins)"
LANG_CODE = r"^(x-default|[a-z]{2,3}(-[A-Z][a-z]{3})?(-([A-Z]{2}|\d{3}))?)$"
DISPUTED_LANG_CODES = ["en-UK", "en-EU", "zh-CN"]
SITEMAP_LIMIT = 50000

# required properties by structured-data type
REQUIRED_PROPERTIES = {
    "Product": ["name"],
    "Event": ["name", "startDate", "location"],
    "Recipe": ["name", "recipeIngredient", "recipeInstructions"],
    "SoftwareApplication": ["name", "offers"],
    "LegalService": ["name", "address", "telephone"],
    "LocalBusiness": ["name", "address", "telephone"],
    "Organization": ["name", "url"],
    "FAQPage": ["mainEntity"],
    "Article": ["headline", "author"],
    "Person": ["name"],
    "BreadcrumbList": ["itemListElement"],
    "Service": ["name", "provider"],
}

# --- distributions -------------------------------------------------------------------------
TITLE_PX_EDGES = [200, 300, 400, 500, 580]
WORD_EDGES = [100, 300, 600, 1200, 2500]
INBOUND_EDGES = [0, 1, 3, 10, 30]
RESPONSE_EDGES = [200, 500, 1000, 2000, 4000]

# --- access logs -----------------------------------------------------------------------------
COMBINED_LINE = (
    r'^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) ([^"]*?) (\S+)" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?'
)
# (bot id, label, pattern), first match wins
BOT_PATTERNS = [
    ("googlebot", "Googlebot", r"(?i)Googlebot(?!-Image|-Video|-News)"),
    ("googlebotImage", "Googlebot-Image", r"(?i)Googlebot-Image"),
    ("bingbot", "Bingbot", r"(?i)bingbot|BingPreview"),
    ("gptbot", "GPTBot", r"(?i)GPTBot"),
    ("claudebot", "ClaudeBot", r"(?i)ClaudeBot|Claude-Web"),
    ("perplexity", "PerplexityBot", r"(?i)PerplexityBot"),
    ("ahrefs", "AhrefsBot", r"(?i)AhrefsBot"),
    ("semrush", "SemrushBot", r"(?i)SemrushBot"),
    ("other", "Other bots", r"(?i)bot|crawler|spider|slurp"),
]
GOOGLE_PREFIXES = ["66.249.", "64.233.", "72.14.", "74.125.", "209.85.", "216.239.", "35.247.", "34.", "35."]
BING_PREFIXES = ["157.55.", "207.46.", "40.77.", "13.66."]
BOT_PREFIXES = {"googlebot": GOOGLE_PREFIXES, "googlebotImage": GOOGLE_PREFIXES, "bingbot": BING_PREFIXES}
SLOW_HIT_MS = 1000

# --- search performance ---------------------------------------------------------------------------
SEARCH_HEADERS = {
    "query": ["top queries", "query", "queries", "search query", "requêtes les plus fréquentes",
              "consultas principales", "suchanfrage"],
    "page": ["top pages", "page", "pages", "landing page", "url", "pages les plus populaires",
             "páginas principales"],
    "date": ["date", "dates", "fecha", "datum"],
    "country": ["country", "countries", "pays", "país"],
    "device": ["device", "devices", "appareil", "dispositivo"],
    "clicks": ["clicks", "click", "clics", "klicks"],
    "impressions": ["impressions", "impression", "impresiones", "impressionen"],
    "ctr": ["ctr", "click through rate", "taux de clics"],
    "position": ["position", "average position", "avg. position", "position moyenne", "posición media",
                 "durchschnittliche position"],
}
# expected click-through rate by rounded position
CTR_CURVE_EXPORT = {1: 0.28, 2: 0.15, 3: 0.11, 4: 0.08, 5: 0.06, 6: 0.05, 7: 0.04, 8: 0.033, 9: 0.028, 10: 0.025}
CTR_CURVE_API = {1: 0.28, 2: 0.15, 3: 0.11, 4: 0.08, 5: 0.06, 6: 0.05, 7: 0.04, 8: 0.03, 9: 0.03, 10: 0.025}
CTR_FLOOR = 0.02

# --- demand research -----------------------------------------------------------------------------------
QUESTION_WORDS = ["how", "what", "why", "when", "where", "who", "which", "can", "do", "does", "is", "are",
                  "should", "will"]
COMMERCIAL_SUFFIXES = ["near me", "cost", "price", "best", "top", "reviews", "vs", "attorney", "lawyer",
                       "free", "consultation"]
# (intent, pattern over the padded lower-case keyword), first match wins
KEYWORD_INTENTS = [
    ("transactional", r"\b(buy|hire|price|cost|fee|quote|near me|consultation|book|appointment|contact)\b"),
    ("commercial", r"\b(best|top|vs|versus|compare|review|alternative|cheapest|which)\b"),
    ("informational", r"\b(how|what|why|when|guide|tutorial|meaning|definition|explained|examples?)\b"),
    ("navigational", r"\b(login|sign in|hours|address|phone|location|directions)\b"),
]
# the brief-writing preset of the same idea
TOPIC_INTENTS = [
    ("informational", r"^(how|what|why|when|when to|can i|do i|does|is it)\b|\bguide|tutorial|explained|meaning\b"),
    ("commercial", r"\bbest|top|review|compare|vs\.?|versus|alternative\b"),
    ("transactional", r"\bbuy|price|cost|cheap|deal|order|hire|near me|book\b"),
    ("navigational", r"\blogin|contact|hours|address\b"),
]
KEYWORD_STOP = ["the", "a", "an", "of", "for", "in", "to", "and", "or", "is", "are", "my", "your", "with", "on",
                "at", "how", "what", "why", "can", "do", "does", "near", "me", "best", "top"]
# (template, pattern, intent that also selects it), first match wins
CLUSTER_TEMPLATES = [
    ("service", r"\bbuy|price|cost|order|quote|hire|book\b", "transactional"),
    ("comparison", r"\bbest|top|review|compare|vs\b", "commercial"),
    ("location", r"\bnear me|in [a-z]|location|branch\b", None),
    ("article", r"\bhow|what|why|guide|tutorial\b", "informational"),
]
TEMPLATE_BASE = {"service": "", "comparison": "", "location": "locations", "article": "guides"}
TEMPLATE_SCHEMA = {
    "service": "Service,BreadcrumbList", "comparison": "Article,BreadcrumbList",
    "location": "LocalBusiness,BreadcrumbList", "article": "Article,BreadcrumbList",
}

# --- answers ---------------------------------------------------------------------------------------------
POSITIVE_TERMS = (r"(?i)\b(best|excellent|great|recommend(ed|s)?|top|leading|popular|reliable|trusted|favourite"
                  r"|favorite|strong|quality|renowned|standout)\b")
NEGATIVE_TERMS = (r"(?i)\b(worst|poor|avoid|unreliable|expensive|limited|lacking|criticis(ed|m)|complaint|outdated"
                  r"|weak|disappointing)\b")
BRAND_RUN = r"\b([A-Z][a-zA-Z0-9&'’]+(?: [A-Z][a-zA-Z0-9&'’]+){0,2})\b"
BRAND_STOP = (r"^(The|A|An|And|But|For|If|In|On|At|To|Of|It|This|That|These|Those|You|Your|We|Our|I|As|Is|Are|Was"
              r"|Were|Be|Best|Top|Here|There|When|While|With|However|Also|Some|Many|Most|Other|Both|Each)\b")

# --- summarising --------------------------------------------------------------------------------------------
SUMMARY_STOP = (
    "a about above after again against all am an and any are as at be because been before being below "
    "between both but by can did do does doing down during each few for from further had has have having he her here hers "
    "herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once "
    "only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves "
    "then there these they this those through to too under until up very was we were what when where which while who whom "
    "why will with you your yours yourself yourselves also may said one two get like will"
)
ABBREVIATED_STOP = r"\.(?<=\b(?:Mr|Mrs|Ms|Dr|Prof|Inc|Ltd|Co|vs|etc|e\.g|i\.e|St|No)\.)\s"

# --- result pages ------------------------------------------------------------------------------------------------
# (kind, pattern over "title url"), first match wins
RESULT_KINDS = [
    ("guide", r"(?i)\b(how|guide|tutorial|steps?|checklist|explained|what is|why|tips)\b"),
    ("listicle", r"(?i)\b(best|top \d+|\d+ best|vs\.?|versus|compared?|alternatives|review)\b"),
    ("product", r"(?i)\b(buy|shop|price|for sale|order|store|product)\b"),
    ("service", r"(?i)\b(services?|hire|near me|company|agency|contractor|lawyer|attorney|dentist|plumber)\b"),
    ("location", r"(?i)\b(in [A-Z][a-z]+|near me|directions|hours|address)\b"),
    ("news", r"(?i)\b(news|announce|report|update|\b20\d\d\b)\b"),
]
# (kind, pattern over the lower-case path), first match wins and outranks RESULT_KINDS
PATH_KINDS = [
    ("service", r"/(services?|practice-areas?)/"),
    ("product", r"/(product|shop|store|p|item)/"),
    ("guide", r"/(blog|guides?|articles?|resources|learn|how-to)/"),
]

# --- behaviour and field speed --------------------------------------------------------------------------------------
# (metric, label, severity)
FRICTION_METRICS = [
    ("Rage Click Count", "Rage clicks", "High"),
    ("Dead Click Count", "Dead clicks", "High"),
    ("Script Error Count", "Script errors", "High"),
    ("Quickback Click", "Quickbacks", "Medium"),
    ("Excessive Scroll", "Excessive scrolling", "Medium"),
    ("Error Click Count", "Error clicks", "High"),
]
# (metric, label, good up to, needs improvement up to)
FIELD_THRESHOLDS = [
    ("largest_contentful_paint", "LCP", 2500.0, 4000.0),
    ("interaction_to_next_paint", "INP", 200.0, 500.0),
    ("cumulative_layout_shift", "CLS", 0.1, 0.25),
    ("experimental_time_to_first_byte", "TTFB", 800.0, 1800.0),
]
LAB_THRESHOLDS = [
    ("LARGEST_CONTENTFUL_PAINT_MS", "LCP", 2500.0, 4000.0),
    ("INTERACTION_TO_NEXT_PAINT", "INP", 200.0, 500.0),
    ("CUMULATIVE_LAYOUT_SHIFT_SCORE", "CLS", 0.1, 0.25),
    ("FIRST_CONTENTFUL_PAINT_MS", "FCP", 1800.0, 3000.0),
    ("EXPERIMENTAL_TIME_TO_FIRST_BYTE", "TTFB", 800.0, 1800.0),
]
LAB_DIAGNOSTICS = [
    "uses-responsive-images", "modern-image-formats", "unused-css-rules", "unused-javascript",
    "render-blocking-resources", "server-response-time", "uses-text-compression", "font-display",
    "third-party-summary", "largest-contentful-paint-element", "layout-shift-elements",
]
