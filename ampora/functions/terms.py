"""Term lists and patterns that decide results; fixed values, the same wherever pages are judged."""

from __future__ import annotations

# Words of the energy business.
ENERGY = r"光伏|储能|新能源|太阳能|风电|电站|EPC|solar|photovoltaic|battery|storage|renewable|wind\s*(?:farm|power|energy)|energy project"
# Words of a project and its events.
PROJECT = r"项目|电站|电场|园区|基地|中标|开工|投产|并网|签署|合同|收购|融资|获批|project|plant|farm|facility|site|award|contract|construction|commission|acqui|financ|approv"
# Words that add nothing to a project's name.
NAME_STOP_WORDS = ("solar", "pv", "photovoltaic", "battery", "energy", "storage", "project", "power", "plant", "farm")
# Words of a name that is a project's.
PROJECT_SIGNAL = r"项目|电站|电场|园区|基地|工程|储能|光伏|风电|project|plant|farm|facility|park"
# File types that hold no page.
FILE_TYPES = ("jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "css", "js", "woff", "woff2", "ttf", "zip", "rar", "pdf", "xls", "xlsx", "doc", "docx", "ppt", "pptx", "mp4", "mp3")
# Paths of content and of archives.
CONTENT_PATH = r"news|press|media|article|story|project|blog|insight|announcement|release|20\d{2}[/-]\d{1,2}"
ARCHIVE_PATH = r"news|press|media|articles?|archive|category|page|posts?|updates?|search|col(?:umn)?|channel|index|20\d{2}"
# Messages of pages that turn a reader away, by code, in order.
BLOCKS = {
    "BOT_CHALLENGE": r"captcha|verify (?:that )?you are human|checking your browser|just a moment|cloudflare|人机验证|验证码|安全验证",
    "ACCESS_DENIED": r"access denied|request (?:has been )?blocked|permission denied|forbidden|拒绝访问|访问被拒绝|无权访问",
}
# Where the country is the domestic one.
DOMESTIC = r"中国|大陆|国内|内地|香港|澳门|台湾|hong\s*kong|macau|taiwan|^\s*china\s*$|^\s*prc\s*$"
# Points of a discovered address by the way it was found.
METHOD_POINTS = {"rss": 45, "page-link": 35, "archive": 25, "sitemap": 20, "search": 18, "mcp": 18, "source": 0}
# Countries that a report may name, in the order in which they are looked for.
COUNTRIES = (
    "菲律宾", "马来西亚", "塔吉克斯坦", "缅甸", "乌兹别克斯坦", "新加坡", "阿联酋", "沙特", "赞比亚", "南非", "坦桑尼亚", "萨尔瓦多", "哥伦比亚", "罗马尼亚", "芬兰", "波兰", "意大利", "波黑", "埃及", "圭亚那", "吉尔吉斯斯坦", "格鲁吉亚", "新西兰", "越南", "莱索托",
    "蒙古国", "印度尼西亚", "澳大利亚", "老挝", "泰国", "日本", "埃塞俄比亚", "智利", "布基纳法索", "柬埔寨", "阿曼", "哈萨克斯坦", "匈牙利", "科摩罗", "美国", "英国", "德国", "法国", "西班牙", "葡萄牙", "希腊", "土耳其", "巴西", "墨西哥", "加拿大", "印度", "巴基斯坦",
)
# An address of an article, of a list, of a product.
ARTICLE_URL = r"\.(?:s?html?|pdf)$|/details?/|/content[_/-]|/articles?/|/news/|/20\d{2}[-/]"
LISTING_URL = r"(?:^|/)(?:archive|category|search|list|page)(?:/|$)"
PRODUCT_URL = r"case[_-]?details?|products?[_-]?details?|/products?/|product[_-]?info|tagdetail"
# A title that names no article, and words that don't tell articles apart.
GENERIC_TITLE = r"^(?:首页|集团要闻|公司新闻|新闻中心|企业动态|中国.+(?:集团|有限公司)|home|news)$"
COMMON_TITLE_TERM = r"集团|有限|公司|project|energy|news|solar|battery|storage|power|wind"
# Events that a project passes.
MILESTONE = r"签(?:署|订)?[^。；\n]{0,30}(?:合同|协议|备忘录)|中标|开工|投产|并网|招标|获得环境审批|融资闭环"
