"""Limits, thresholds, word lists and patterns."""

# Fixed values, as results depend on them.
TRACKING_PARAMS = ("fbclid", "gclid", "mc_cid", "mc_eid", "igshid", "ref_src", "spm")
RESULTS_PER_QUERY = 30
CHUNK_MIN, CHUNK_TARGET, CHUNK_MAX, FALLBACK_CHUNKS = 80, 900, 1400, 12
GROUP_COVERAGE, DOMAIN_CAP = 3, 2
#: Results a provider gives for one query at most; 100 for others.
PROVIDER_CAPS = {"searxng": 1, "brave": 20, "tavily": 20, "exa": 100, "serpapi_google": 100, "serpapi_google_scholar": 20, "serpapi_google_forums": 100}
#: min, target and max pages of a crawl round.
BUDGETS = {"instant": (3, 4, 5), "fast": (6, 9, 11), "fast_second": (3, 4, 5), "full": (6, 8, 9), "narrow": (2, 3, 4)}
SITE_GROUPS = (("ptt.cc", "dcard.tw", "mobile01.com", "forum.gamer.com.tw"), ("reddit.com", "news.ycombinator.com", "lemmy.world", "mastodon.social"))
MOST_SITE_QUERIES = 3
HISTORY_MESSAGES, HISTORY_TOKENS, REUSE_TOKENS, CAPSULE_TOKENS, CAPSULE_VERSION = 16, 6000, 8000, 12000, 1
DIRECT_TOKENS, DIRECT_URLS, REFRESH_URLS = 6000, 5, 2
#: By language class: short line, long line, accepted score, score that asks for rendering, least usable score.
PROFILES = {"cjk": (16, 36, 520, 360, 40), "thai": (24, 56, 620, 420, 60), "latin": (40, 80, 900, 650, 90)}
TEXT_ACCEPT, TEXT_FORCE_JS, SUCCESS_MIN = 450, 220, 120
LONG_LENGTH, LONG_SCORE, LONG_NAV, LONG_SHORT_RATIO = 650, 420, 8, 0.72

# Fixed patterns, as results depend on them.
LOW_VALUE = (
    (r"please\s+enable\s+js", "BLOCKER_ENABLE_JS"),
    (r"please\s+enable\s+javascript", "BLOCKER_ENABLE_JS"),
    (r"sorry,?\s+something\s+went\s+wrong", "BLOCKER_ERROR_PAGE"),
    (r"access\s+denied", "BLOCKER_ACCESS_DENIED"),
    (r"verify\s+you\s+are\s+human", "BLOCKER_ANTI_BOT"),
    (r"just\s+a\s+moment", "BLOCKER_ANTI_BOT"),
    (r"cloudflare", "BLOCKER_ANTI_BOT"),
)
NAV_MARKS = ("首頁", "首页", "關於", "关于", "聯絡", "联系", "登入", "登录", "註冊", "注册", "訂閱", "订阅", "隱私", "隐私", "條款", "条款", "搜尋", "搜索", "回到頂部", "回到顶部", "下一頁", "上一页", "上一頁", "上一页", "ホーム", "お問い合わせ", "ログイン", "会員登録", "利用規約", "検索", "홈", "소개", "문의", "로그인", "회원가입", "약관", "검색", "หน้าแรก", "ติดต่อ", "เข้าสู่ระบบ", "สมัครสมาชิก", "นโยบาย", "ค้นหา")
NAV_WORDS = (r"home", r"about", r"contact", r"login", r"sign\s*in", r"subscribe", r"privacy", r"terms", r"cookies?", r"menu", r"search")
LEADING_UI = r"(?:\bedition\b|\bsign\s*(?:in|out)\b|\bshare\b|\btext\s*size\b|\btoday'?s\s+epaper\b|\bget\s+app\b|\bdownload\s+app\b|\bnewsletter(?:s)?\b|\bsaved\s+articles\b|\bfollowing\b|\bmy\s+reads\b|\bweather(?:\s+today)?\b|\bprivacy\s+policy\b|\bterms\s+of\s+use\b|\bcontact\s+us\b|\babout\s+us\b|\bprint\s+ad\s+rates\b|\bcode\s+of\s+ethics\b|\bsitemap\b|\brss\s+feeds\b|\bimage\s+source\b|\bphoto\s+credit\b|\bcomments?\b|隱私政策|隐私政策|使用條款|使用条款|聯絡我們|联系我们|關於我們|关于我们|分享|字體大小|字体大小|下載App|下载App|訂閱電子報|订阅电子报|ホーム|シェア|ログイン|利用規約|お問い合わせ|공유|로그인|문의하기|이용약관|แชร์|เข้าสู่ระบบ|ข้อกำหนดการใช้งาน|ติดต่อเรา)"
TRAILING = r"(?:\bfollow\s+us\b|\balso\s+read\b|\bread\s+more\b|\brecommended\b|\brelated\s+(?:articles?|stories|news)\b|\byou\s+may\s+also\s+like\b|\blatest\s+updates\b|\blive\s+updates\b|\btop\s+stories\b|\bmost\s+read\b|\btrending\b|\bnewsletter(?:s)?\b|\ball\s+rights\s+reserved\b|延伸閱讀|延伸阅读|相關文章|相关文章|更多報導|更多报道|最新更新|即時更新|热门|最受歡迎|最受欢迎|関連記事|おすすめ|続きを読む|最新情報|人気記事|관련 기사|추천 기사|더 읽기|실시간 업데이트|อ่านเพิ่มเติม|บทความที่เกี่ยวข้อง|อัปเดตล่าสุด|กำลังมาแรง)"
# Lines of page shells, and lines that end a text.
SHELL_LINE = (
    r"(?:^跳到主要內容區塊$|^搜尋$|^進階搜尋$|^分享$|^分享至\b|^首頁$|^上方連結$|^下方連結$|^網站導覽$|^回首頁$|^熱門關鍵字$|^最新消息$|^網頁功能$|^列印內容$|^注音$|^回上一頁$|^English$|^常見問答$|^隱私權政策$|^網站安全政策$"
    r"|^著作權聲明$|^政府網站資料開放宣告$|^維基百科，自由的百科全書$|^相關圖片$|^點閱數[:：]?$|^資料更新[:：]?$|^資料檢視[:：]?$|^資料維護[:：]?$|^更多.+報導$|^##\s*相關內容$|^相關內容$|^延伸閱讀$|^參考資料$|^注釋$|^註釋$|^外部連結$|^分類$|^隱藏分類[:：]?$|^取自「$)"
)
CUT_LINE = (
    r"(?:^##\s*相關內容$|^相關內容$|^更多.+報導$|^延伸閱讀$|^相關文章$|^相關圖片$|^注釋$|^註釋$|^參考資料$|^外部連結$|^分類$|^隱藏分類[:：]?$|^回上一頁$|^點閱數[:：]?$|^資料更新[:：]?$|^資料檢視[:：]?$|^資料維護[:：]?$"
    r"|^地址：|^總機：|^傳真：|^服務時間：|^本網站內容版權屬|^本網站建議最佳瀏覽解析度|^瀏覽人次$|^下方連結$|^最新消息$)"
)
CUT_INLINE = r"\n(?:##\s*相關內容|相關內容|更多[^。\n]{0,40}報導)"
FOOTNOTE_LINE = r"^(?:\[\s*編輯\s*\]|\[\s*\d+(?:\.\d+)?\s*\]|\^+|[<>|/:：\-_=]{2,}|:::+)$"
FOOTNOTE = r"\[\s*(?:編輯|\d+(?:\.\d+)?)\s*\]"
CONNECTIVE = "[的了在於是為有與及因從並將則而]"
ANTI_BOT = r"(?:cloudflare|anti[-\s]?bot|verify\s+you\s+are\s+human|just\s+a\s+moment|captcha|cf-chl|challenge-platform|access\s+denied)"
BROWSER_MISSING = r"(?:executable\s+doesn'?t\s+exist|playwright\s+install|download\s+new\s+browsers?|browser(?:\s+binary)?\s+not\s+found|no\s+chromium)"
COMMENT_UI = r"(?:\bcomments?\b|\bcomment\s*section\b|\brepl(?:y|ies)\b|留言|評論|评论|回覆|ความคิดเห็น|แสดงความคิดเห็น)"
COMMENT_ITEM = r"(?:comment\s*#?\s*\d+|reply\s*#?\s*\d+|ความคิดเห็นที่\s*\d+|留言\s*\d+|评论\s*\d+)"
COMMENT_DYNAMIC = r"(?:javascript:void\(0\)|\bload\s+more\b|\bshow\s+more\b|\bview\s+all\s+comments\b|\bwrite\s+a\s+comment\b|\badd\s+a\s+comment\b|แสดงความคิดเห็น|留言)"
JS_SIGNALS = (r"please\s+enable\s+javascript", r"requires\s+javascript", r"<div[^>]+id=['\"](?:root|app|__next)['\"]", r"window\.__NUXT__", r"window\.__NEXT_DATA__")
INTERACTIVE_PATH = r"(?:^|[/_.-])(?:topic|thread|discussion|discuss|forum|forums|comment|comments|reply|replies|post|posts|question|questions|answer|answers|talk|community)(?:$|[/_.-])"
INTERACTIVE_QUERY = r"(?:^|&)(?:comment|comments|reply|thread|topic|discussion|post|question)="
EXPLICIT_URL = r"""https?://[^\s<>{}\[\]\"'，。；：！？、】【（）《》「」『』]+"""
REVIEW_TERM = r"[A-Za-z0-9_+-]{3,}|[一-鿿]{2,}"
MOST_TERMS = 24

# Elements of pages.
#: Not shown in a page's text; the last three hold no text of it at all.
HIDDEN_TAGS = ("script", "style", "noscript", "iframe", "svg", "canvas", "nav", "footer", "aside", "header", "form", "template", "rt", "rp")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: An end tag does not reach past an open element of more weight; others weigh 100.
END_WEIGHTS = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}
MAIN_SOURCES = ("html_article", "html_main", "html_role_main", "html_article_body")

#: Answers after which a second request may help.
RETRY_STATUS = (408, 425, 429, 500, 502, 503, 504)
