"""Patterns and word lists, and their forms for the two regular-expression
engines that use them.

A pattern is written once, with \\b as an ASCII word boundary and \\s as Unicode
white space.  `java` makes it Spark's: its engine takes \\b as it is on Unicode
letters and \\s as ASCII.  `re2` makes it DuckDB's.
"""

from __future__ import annotations

import functools
import re

#: white space as web scripts see it
SPACE = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_BEGIN, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _close(pattern: str, at: int) -> int:
    """The end of the group that opens at `at`."""
    depth, inside, k = 0, False, at
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        else:
            depth += (c == "(") - (c == ")")
            if depth == 0:
                return k
        k += 1
    return len(pattern)


def _choices(body: str) -> list[str]:
    """The alternatives of a group's body, inner groups left whole."""
    out, start, k, inside = [], 0, 0, False
    while k < len(body):
        c = body[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            k = _close(body, k)
        elif c == "|":
            out.append(body[start:k])
            start = k + 1
        k += 1
    return [*out, body[start:]]


def _worded(pattern: str, first: bool) -> bool:
    """Whether a pattern surely begins (ends) with a word character."""
    if first:
        if pattern.startswith("("):
            end = _close(pattern, 0)
            body = pattern[3:end] if pattern.startswith("(?:") else pattern[1:end]
            return pattern[end + 1 : end + 2] not in ("?", "*", "{") and all(_worded(c, True) for c in _choices(body))
        follow = pattern[1:2] if pattern[:1] != "\\" else pattern[2:3]
        return (pattern[:1].isalnum() and pattern.isascii() or pattern.startswith("\\d")) and follow not in ("?", "*", "{")
    if pattern.endswith(")") and not pattern.endswith("\\)"):
        starts = [k for k in range(len(pattern)) if pattern[k] == "(" and (k == 0 or pattern[k - 1] != "\\") and _close(pattern, k) == len(pattern) - 1]
        body = pattern[starts[0] :] if starts else ""
        body = body[3:-1] if body.startswith("(?:") else body[1:-1]
        return bool(body) and not body.startswith("?") and all(_worded(c, False) for c in _choices(body))
    return pattern[-1:].isascii() and pattern[-1:].isalnum() and (pattern[-2:-1] != "\\" or pattern[-1:] == "d")


def _edges(pattern: str) -> str:
    """Word boundaries whose side is known as one look to that side, which is
    much faster than the general form; group by group."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two[:1] == "\\":
            if two == "\\b" and not inside:
                begins = _worded(pattern[k + 2 :], True)
                ends = _worded(_before(pattern[:k]), False)
                out.append(_EDGE if begins == ends else _BEGIN if begins else _END)
            else:
                out.append(two)
            k += 2
            continue
        inside = two[0] == "[" or (inside and two[0] != "]")
        out.append(two[0])
        k += 1
    return "".join(out)


def _before(text: str) -> str:
    """What stands right before a place, in its own alternative."""
    depth, k = 0, len(text) - 1
    while k >= 0:
        if k and text[k - 1] == "\\":
            k -= 2
            continue
        depth += (text[k] == ")") - (text[k] == "(")
        if depth < 0 or (depth == 0 and text[k] == "|"):
            return text[k + 1 :]
        k -= 1
    return text


def _spaces(pattern: str) -> str:
    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\S":
            out.append(f"[^{SPACE}]")
        elif two[:1] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            k -= 1
        k += 2
    return "".join(out)


@functools.cache
def java(pattern: str) -> str:
    """For Spark."""
    return _spaces(_edges(pattern))


def re2(pattern: str) -> str:
    """For DuckDB."""
    return _spaces(pattern)


def literal(text: str) -> str:
    """An SQL string."""
    return "'" + text.replace("'", "''") + "'"


def sql(pattern: str) -> str:
    """A DuckDB pattern as an SQL string."""
    return literal(re2(pattern))


def script(pattern: str, flags: str = "i") -> str:
    """A pattern as reasons quote it."""
    return "/" + re.sub(r"^\(\?i\)", "", pattern) + "/" + flags


# --- fixed values: they decide results, so they are stated as they must be ---

HTML_TAG = r"(?i)<\s*(?:!DOCTYPE|html|body|div|p|span|table|h[1-6]|ul|ol|li|section|article|header|footer|script|style|main|nav|aside|form|blockquote|pre|code)\b"

FILE_EXTENSION = r"(?i)\.(?:pdf|png|jpe?g|webp|gif|svg|ico|bmp|tiff|avif|mp4|webm|avi|mov|mkv|mp3|wav|ogg|flac|m4a|zip|tar|gz|rar|7z|exe|dmg|apk|iso|bin|css|js|mjs|json|xml|rss|atom|woff2?|ttf|eot|otf)$"
ASSET_PATH = r"(?i)/cdn-cgi/|/wp-content/uploads/|/assets/(?:images|img|css|js|fonts)/"

#: page types in the order in which they are tried on the path
PATH_TYPES = (
    ("contact_page", r"contact|reach-us|get-in-touch|support|contact-us|location|locations|branches"),
    ("about_page", r"about|company|team|who-we-are|our-story|mission|vision|history|leadership"),
    ("product_page", r"product|products|shop|store|catalog|item|sku|cart|buy|/p/|/dp/|/pd/|collection|collections|spec|specs|specification|specifications"),
    ("service_page", r"service|services|solution|solutions|offering|offerings"),
    ("faq_page", r"faq|faqs|help|knowledge|knowledgebase|support-faq"),
    ("blog_page", r"blog|blogs|article|articles|news|post|posts"),
    ("pricing_page", r"pricing|plans|price|prices|subscription|rates"),
)
HOME_PATHS = ("", "/", "/index.html", "/index.php")
SCHEMA_TYPES = (
    ("product_page", ("product", "individualproduct", "someproduct")),
    ("faq_page", ("faqpage",)),
    ("contact_page", ("contactpage", "localbusiness")),
    ("about_page", ("aboutpage",)),
    ("service_page", ("service",)),
    ("blog_page", ("article", "blogposting", "newsarticle")),
)
OG_TYPES = (("product_page", "product"), ("blog_page", "article"))
TITLE_TYPES = (("contact_page", r"contact us|get in touch"), ("faq_page", r"frequently asked questions|faq"), ("about_page", r"about us|who we are"), ("pricing_page", r"pricing|plans"))
BODY_TYPES = (
    ("product_page", r"\b(?:add to cart|buy now|in stock|out of stock|sku:|item #|msrp:|add to bag|checkout)\b"),
    ("faq_page", r"frequently asked questions|f\.a\.q\.|faq"),
    ("about_page", r"about us|our mission|who we are"),
)

EXCLUDED_URLS = (r"(?i)sitemap", r"(?i)\/cart", r"(?i)\/checkout", r"(?i)\/account", r"(?i)\/login", r"(?i)\/register", r"(?i)\/search", r"(?i)\/wishlist", r"(?i)\/order")
ERROR_PAGES = (
    r"(?i)404\s*-\s*page\s*not\s*found", r"(?i)page\s*not\s*found", r"(?i)403\s*forbidden", r"(?i)access\s*denied", r"(?i)500\s*internal\s*server\s*error",
    r"(?i)service\s*unavailable", r"(?i)the\s*requested\s*url\s*was\s*not\s*found", r"(?i)this\s*domain\s*is\s*parked", r"(?i)under\s*maintenance",
)
LEAST_WORDS = 30

EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}"
DATE_LIKE = r"^\d{4}[-/]\d{2}[-/]\d{2}$"
ADDRESS_LIKE = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
CJK = r"[\x{4e00}-\x{9fa5}\x{3040}-\x{30ff}\x{ac00}-\x{d7a3}]"
NOISE = ((r'(?i)\{[\x{0}-\x{10ffff}]*?"variant_id"[\x{0}-\x{10ffff}]*?\}', ""), (r'(?i)\{[\x{0}-\x{10ffff}]*?"product_id"[\x{0}-\x{10ffff}]*?\}', ""), (r"data:image\/[a-zA-Z]+;base64,[a-zA-Z0-9+/=]+", ""), (r"\n{3,}", "\n\n"))

PRICES = (
    r"(?i)(?:price|cost|msrp|pricing|rate|special price|now|was):\s*(?:(USD|EUR|GBP|INR|\$|₹|£|€)\s*)?([\d,]+(?:\.\d{1,2})?)",
    r"(?i)(?:(USD|EUR|GBP|INR|\$|₹|£|€)\s*)([\d,]+(?:\.\d{1,2})?)",
    r"(?i)\b([\d,]+(?:\.\d{1,2})?)\s*(?:rupees?|rs\.?|inr|bucks)\b",
)
CURRENCIES = (("$", "USD"), ("₹", "INR"), ("€", "EUR"), ("£", "GBP"))
PAGE_COLORS = ("black", "white", "red", "blue", "green", "yellow", "pink", "purple", "grey", "gray", "brown", "navy", "maroon", "beige")
PAGE_SIZES = ("S", "M", "L", "XL", "XXL", "3XL", "Small", "Medium", "Large")
PAGE_NUMBER_SIZE = r"(?i)\b(?:size|waist|uk|us|eu)\s*[:=]?\s*(\d{1,2}(?:\.\d)?)\b"
OUT_OF_STOCK = r"(?i)\b(?:out\s+of\s+stock|outofstock|out-of-stock|sold\s+out|currently\s+unavailable|backorder|un-available)\b"
IN_STOCK = r"(?i)\b(?:in\s+stock|instock|in-stock|add\s+to\s+cart|add\s+to\s+bag|buy\s+now|ready\s+to\s+ship|available\s+now)\b"

QUERY_COLORS = ("black", "white", "red", "blue", "green", "yellow", "pink", "purple", "orange", "grey", "gray", "brown", "navy", "maroon", "beige", "gold", "silver")
QUERY_SIZES = ("xs", "s", "m", "l", "xl", "xxl", "3xl", "small", "medium", "large", "extra large")
RANGE = r"(?:between|from)\s+(?:₹|\$|rs\.?|inr)?\s*(\d+(?:\.\d+)?)\s*(?:and|to|-)\s*(?:₹|\$|rs\.?|inr)?\s*(\d+(?:\.\d+)?)"
AT_MOST = (r"(?:under|below|less than|<|up to|within|around|costing|budget of)\s*(?:₹|\$|rs\.?|inr)?\s*(\d+(?:\.\d+)?)", r"(\d+(?:\.\d+)?)\s*(?:rupees?|rs|inr|bucks|\$)?\s*(?:or less|under|below|max)")
AT_LEAST = r"(?:above|more than|>|over|at least|starting from)\s*(?:₹|\$|rs\.?|inr)?\s*(\d+(?:\.\d+)?)"
NUMBER_SIZE = r"\b(?:size\s*[:=]?\s*|waist\s*[:=]?\s*|uk\s+|us\s+|eu\s+)?(\d{1,2}(?:\.\d)?)\s*(?:size|waist|uk|us|eu)?\b"
STANDALONE_SIZE = r"\b(xs|s|m|l|xl|xxl|3xl)\b(?:\s+(?:t-?shirt|shirt|pants|dress|shoes|size))?"
NO_SIZE = r"\b(?:does\s+not|doesn't|don't|no|not|without|out\s+of)\s+have\b.*\b(?:size|sizes)\b|\b(?:no|not)\s+(?:size|sizes)\b"
COMPARES = r"\b(?:compare|versus|\bvs\b|difference between|differ|better than|which is better|which one to buy)\b"
WANTS_STOCK = r"\b(?:in\s+stock|instock|in-stock|available|ready\s+to\s+ship|is\s+it\s+available|are\s+they\s+available|show\s+available|available\s+items)\b"
WANTS_NO_STOCK = r"\b(?:out\s+of\s+stock|not\s+in\s+stock|un-available|sold\s+out)\b"
FLUFF = r"\b(?:how can you say that|how come|why do you say|this product does not have|does not have|how to buy|can you tell me if|i want to know if)\b"
COMPLEX = r"(?i)\b(?:looking for|suggest|recommend|cheaper|expensive|affordable|options|best|top)\b"

GRATITUDE = r"(?i)^(?:thanks|thank you|thx|appreciate|thank|great|awesome|perfect|cool|ok|okay|nice|sounds good|got it|thank\s*you\s*so\s*much|thanks\s*a\s*lot)[!?.]*$"
GREETING = r"(?i)^(?:hi|hello|hey|good morning|good evening|good afternoon|howdy|sup|greetings|whats up|what's up|what up|how are you|how's it going|nice to meet you|good day|你好|hola|bonjour|hallo|ciao)(?:[\s,]+(?:bud|buddy|friend|pal|man|bro|there|all))?[!?.]*$"
SMALL_TALK = r"(?i)^(?:whats up|what's up|how are you|how is it going|how's it going|who are you|what can you do|who made you|nice to meet you|good day)"
INTENTS = (
    ("product", r"(?i)product|item|catalog|shop|buy|purchase|price|cost|how much|offer|deal|sale|discount|sku|in stock|available|order|compare|pricing|plan|subscription|package|tier|fee|charge|affordable|recommendation|recommend|suggest|suggestion|option|choice|variant|difference|diff|spec|specs|specification|specifications|feature|features|material|fabric|quality|detail|details|precio|comprar|价格|买|购买|producto|acheter|prix"),
    ("contact", r"(?i)contact|email|phone|call|reach|address|location|whatsapp|support|help desk|get in touch|contacto|联系|电话|邮箱"),
    ("about", r"(?i)about|company|team|who are|history|mission|vision|founded|sobre|关于|公司"),
    ("faq", r"(?i)faq|common question|frequently asked|preguntas|常见问题"),
    ("navigation", r"(?i)how (?:do|can) i|where (?:do|can) i|how to|steps|guide|tutorial|find|locate|navigate|como|怎么|如何"),
)
BRANCHES = (("greeting", "greeting"), ("gratitude", "gratitude"), ("vague", "clarify"), ("product", "product"))
AUGMENTATIONS = (
    ("product", "product description price features availability buy purchase"), ("contact", "contact information email phone address location"), ("about", "company about us mission team history"),
    ("faq", "frequently asked questions answers"), ("navigation", "steps how to guide instructions"),
)
GUARDRAILS = (
    r"(?i)ignore (?:all )?(?:previous|prior|above|your) (?:instructions?|prompts?|context|rules?)",
    r"(?i)act as (?:a |an )?(?:different|new|another|evil|unrestricted|uncensored|gpt|chatgpt|openai)",
    r"(?i)you are now|pretend (?:you are|to be)|role[\s-]?play as",
    r"(?i)jailbreak|dan mode|developer mode|god mode|bypass (?:your )?(?:rules?|restrictions?|filters?|safety)",
    r"(?i)forget (?:your|all) (?:instructions?|training|rules?|guidelines?|constraints?)",
    r"(?i)prompt injection|override (?:the )?(?:system|instructions?|prompt)|system prompt",
    r"(?i)disregard (?:your|all|any) (?:previous|prior|above) (?:instructions?|prompts?)",
)

#: replies to greetings in the order in which they are tried; @ is the business
GREETING_REPLIES = (
    (r"bye|goodbye|see ya|cya|farewell", "Goodbye! Have a great day!"),
    (r"whats up|what's up|sup|what up", "Not much! I'm here to help you with any questions about @. What can I help you find today?"),
    (r"how are you|how's it going|how do you do", "I'm doing great, thank you! How can I assist you with @ today?"),
)
GREETING_AGAIN = "Let me know if there's anything else I can help you find regarding @!"
GREETING_FIRST = "Hi! I'm the AI assistant for @. How can I help you today?"
GRATITUDE_REPLY = "Glad I could help! Let me know if there's anything else I can help you with regarding @."
GUARDED_REPLY = "I'm here to help with questions about @. How can I assist you today?"
#: what stands for a business without a name
SITE, GOODS = "this website", "our products"
#: the paths that a log takes; a gratitude turn isn't among them
LOGGED_PATHS = ("semantic", "structured", "clarify", "greeting", "abstained", "none")

PRONOUNS = r"(?i)\b(?:it|this|that|they|them|its|their|these|those|the product|the item)\b"
IMPLICIT = r"(?i)^(?:give me the link|give link|link|show link|url|website link|where to buy|how to buy|what is the price|price|cost|is it in stock|buy link)\b"
OBJECTION = r"(?i)\b(?:wrong|incorrect|not have|does not have|doesn't have|how can you say)\b"
STANDALONE = r"(?i)^(?:what|where|who|why|how do|how can|do you|can you|is there|are there|tell me)\b"
BOLD = r"\*\*([^*]{2,60})\*\*"
BOLD_PREFIX = r"(?i)^(?:Title:|Product:|\s)+"
GENERIC_BOLD = r"(?i)^(?:Key Features|Colors Available|Sizes Available|Price|Description|Key Differences|About page|About Us|Contact Us|Home|Header|Footer|Note|Warning)$"
LINK_TEXT = r"\[([^\]]{2,60})\]\("
LINK_PREFIX = r"(?i)^(?:here|link|website|view|\s)+"
GENERIC_LINK = r"(?i)^(?:here|link|website|view|about|contact|home)$"
SPEC_WORDS = r"(?i)\b(?:feature|features|spec|specs|specification|specifications|material|fabric)\b"
SPEC_SUFFIX = "specifications features material fabric details"

CORRECTION = r"(?i)\b(?:wrong|incorrect|invalid|error|showing the wrong|not right)\b"
DIRECT = r"https?:\/\/|[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}|\+?\d{10,}"
AMBIGUOUS = r"(?i)\b(?:it|this|that|they|them|its|their|these|those|there)\b"
DISCOVERY = r"(?i)\b(?:catalog|catalogs|collection|collections|category|categories|what do you sell|what do you offer|what do you provide|all products)\b"
CATALOG = r"(?i)\b(?:catalog|catalogs)\b"
CATALOG_SUFFIX = "collections categories products apparel items"
CATALOG_QUERY = r"(?i)\b(?:catalog|catalogs|collection|collections|category|categories|products|items|what do you sell|what do you offer|what do you provide)\b"
ENTITY_SUFFIX = "product description price specs features"

ENGLISH_PHRASE = r"(?i)^(?:hi|hello|hey|help|yes|no|ok|okay|thanks|thank you|pricing|products?|what|how|where|who|why|when|map|address|email|phone|info|about)[!?.]*$"
ENGLISH_WORDS = tuple(
    "the be to of and a in that have i it for not on with he as you do at this but his by from we say her she or an will my one all would there their what so up out if about who get which go me "
    "make can like time no just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even".split()
)
LANGUAGE_NAMES = (
    ("eng", "English"), ("ara", "Arabic"), ("fra", "French"), ("deu", "German"), ("spa", "Spanish"), ("ita", "Italian"), ("por", "Portuguese"), ("rus", "Russian"), ("zho", "Chinese"), ("jpn", "Japanese"),
    ("kor", "Korean"), ("hin", "Hindi"), ("urd", "Urdu"), ("tur", "Turkish"), ("nld", "Dutch"), ("pol", "Polish"), ("ben", "Bengali"), ("vie", "Vietnamese"), ("tha", "Thai"), ("ind", "Indonesian"),
    ("msa", "Malay"), ("swa", "Swahili"), ("fas", "Persian"), ("heb", "Hebrew"), ("ron", "Romanian"), ("ces", "Czech"), ("hun", "Hungarian"), ("fin", "Finnish"), ("swe", "Swedish"), ("nor", "Norwegian"),
    ("dan", "Danish"), ("ukr", "Ukrainian"), ("chi", "Chinese"), ("fre", "French"), ("ger", "German"), ("per", "Persian"),
)
LANGUAGE_ALIASES = (("chi", "zho"), ("fre", "fra"), ("ger", "deu"), ("per", "fas"))
ENGLISH_CODES = ("eng", "nds", "sco", "fuf", "afr")

#: USD: model, for a request, for a token in, out and cached
RATES = (
    ("openai/gpt-4o-mini", 0.0, 0.15 / 1e6, 0.6 / 1e6, 0.075 / 1e6), ("openai/text-embedding-3-small", 0.0, 0.02 / 1e6, 0.0, 0.0), ("baai/bge-reranker-large", 0.0, 0.0, 0.0, 0.0), ("BAAI/bge-reranker-v2-m3", 0.0, 0.0, 0.0, 0.0),
    ("jina/jina-reranker-v3", 0.00002, 0.0, 0.0, 0.0), ("jina-reranker-v3", 0.00002, 0.0, 0.0, 0.0), ("jinaai/jina-reranker-v2-base-multilingual", 0.00002, 0.0, 0.0, 0.0), ("cohere/rerank-v3.5", 0.001, 0.0, 0.0, 0.0),
)
DEFAULT_RATE = (0.0, 0.15 / 1e6, 0.6 / 1e6, 0.075 / 1e6)
# --- end of fixed values ---
