"""Closed vocabularies and patterns, as parameters. The defaults serve Chinese web fiction; tests and the driver's
tables use a Latin set."""

from __future__ import annotations

from dataclasses import dataclass, field

# Excluded terms with the surface forms that stand for them in a text.
TERM_FORMS: dict[str, tuple[str, ...]] = {
    "系统": ("系统", "任务奖励"),
    "穿越": ("穿越", "异世界"),
    "重生": ("重生",),
    "修仙": ("修仙", "筑基", "金丹", "元婴", "渡劫", "灵根", "仙门"),
    "修真": ("修真", "筑基", "金丹", "元婴", "渡劫", "灵根"),
    "恋爱": ("恋爱",),
    "机甲": ("机甲", "驾驶舱"),
    "直播": ("直播", "弹幕", "主播"),
    "校园": ("校园", "班主任", "高考", "学长"),
    "异能": ("异能", "能力者", "异能者", "超能力"),
    "僵尸": ("僵尸", "尸毒", "养尸", "尸王"),
    "变身": ("变身",),
    "兽人": ("兽人", "半兽", "兽族"),
}

# Labels that readers give a book from outside; no text rule decides them.
META_LABELS: tuple[str, ...] = (
    "后宫", "宫斗", "种马", "争霸", "玄幻", "灵异", "超能力", "言情", "恋爱脑", "宠文", "圣母", "玛丽苏", "金手指", "魔改",
    "克苏鲁", "打脸", "虐主", "爽文", "无脑", "小白", "狗血", "开挂", "开局无敌", "速通", "独狼", "压抑", "搞笑",
)

# Genres with their sub-genres.
GENRE_TREE: dict[str, tuple[str, ...]] = {
    "玄幻": ("东方玄幻", "异世大陆", "高武世界"),
    "奇幻": ("剑与魔法", "现代魔法", "史诗奇幻"),
    "武侠": ("传统武侠", "武侠幻想", "国术无双"),
    "仙侠": ("古典仙侠", "幻想修仙", "现代修真"),
    "都市": ("都市生活", "都市异能", "青春校园", "娱乐明星", "商战职场", "官场仕途", "人间百态"),
    "历史": ("架空历史", "上古先秦", "秦汉三国", "两晋隋唐", "五代十国", "两宋元明", "清史民国", "外国历史"),
    "军事": ("军旅特战", "抗战烽火", "谍战特工"),
    "科幻": ("未来科技", "星际文明", "进化变异", "末世危机"),
    "游戏": ("电子竞技", "虚拟网游", "游戏异界"),
    "悬疑灵异": ("诡异神秘", "侦探推理", "灵异民俗"),
    "诸天无限": ("无限", "诸天", "综漫"),
    "言情": ("古代言情", "现代言情", "幻想言情"),
}

# Elements of a card by group, with what counts as having one.
ELEMENT_GROUPS: dict[str, dict[str, str]] = {
    "主角来路": {
        "穿越": "主角从另一个世界或时代来到故事世界",
        "重生": "主角带着前世记忆回到过去或重活一次",
        "穿书": "穿越进一本已知的小说、游戏或影视的世界",
        "强者归来": "开篇主角已是强者，回到弱者身份或故地",
    },
    "外挂与体系": {
        "系统": "有面板、任务、奖励、签到等游戏化外挂",
        "随身空间": "随身携带的空间、位面、农场或仓库",
        "无限流": "主角被投放进一个个独立副本或世界完成任务",
        "诸天": "穿梭多个已知作品或世界，但不是副本制",
        "御兽": "以收服、培养宠物、异兽或召唤物为主要战力",
        "炼丹炼器": "丹药、炼器、阵法、符箓等技艺是主角的主要手段",
        "卡牌": "以卡牌、技能卡、抽卡为核心体系",
        "变身": "主角性别或种族发生变化并持续",
    },
    "流派": {
        "升级流": "情节以境界或等级逐级提升为主线",
        "凡人流": "主角资质平庸，靠谨慎、积累、运气缓慢变强",
        "种田经营": "发展领地、家族、店铺、产业是主线",
        "争霸建国": "势力扩张、攻城略地、建国称帝是主线",
        "学院": "校园或学院是主要舞台",
        "技术流": "以现代知识、科技、工业改变世界为主线",
        "商战": "公司、资本、商业竞争是主线",
        "军旅": "当代军队生活或作战是主线",
        "谍战": "情报、潜伏、反间是主线",
        "娱乐圈": "演艺、文娱产业是主线",
        "直播": "直播或主播是主要形式",
        "游戏": "网游、电竞、游戏制作是主线",
        "美食": "烹饪、餐饮是主线",
        "医术": "医生、医术是主线",
        "刑侦推理": "破案、刑侦、法医、推理是主线",
        "盗墓探险": "盗墓、探险、寻宝是主线",
        "年代": "以 1949 至 2000 年代的中国为背景的现实生活",
        "玄学鉴宝": "相术、风水、鉴宝、算命等玄学技艺是主角主要手段",
        "权谋": "朝堂、家族或势力之间的谋略博弈是主要看点",
        "复仇": "主角以报仇为主线动机",
        "扮猪吃虎": "主角长期隐藏实力或身份，反复在被轻视后翻盘",
    },
    "世界设定": {
        "修仙": "修真、炼气、筑基、飞升等体系",
        "高武": "现代或近未来社会里武道或超凡公开化",
        "异能": "现代背景，人物拥有非修炼来源的特殊能力",
        "末世": "文明崩溃后的生存",
        "丧尸": "丧尸或僵尸是主要威胁",
        "机甲星际": "机甲、星舰、星际文明",
        "克苏鲁诡异": "不可名状、理智值、规则怪谈、诡异复苏",
        "鬼怪灵异": "鬼、灵体、诅咒、凶宅等超自然恐怖",
        "同人": "以已有作品为底本（关键词里写原作名）",
    },
}
ELEMENTS: tuple[str, ...] = tuple(name for group in ELEMENT_GROUPS.values() for name in group)

# Style scales with their options.
STYLES: dict[str, tuple[str, ...]] = {
    "主角结构": ("单一男主", "单一女主", "群像"),
    "爽度": ("高", "中", "低"),
    "基调": ("轻松搞笑", "热血", "沉重压抑", "温馨日常", "悬疑惊悚"),
    "感情线": ("无", "单女主辅线", "单女主主线", "多女主"),
    "主角起点": ("开局无敌", "普通", "废柴逆袭"),
}

# What the style scales mean.
STYLE_NOTES: dict[str, str] = {
    "主角结构": "群像：多视角、多主角，没有单一绝对主角",
    "爽度": "高：冲突迅速解决、主角连续占上风、反复打脸；低：长期受挫、代价沉重",
    "基调": "取最主要的一种",
    "感情线": "多女主：两名以上异性与主角并存、被叙事认可的感情关系，不论分量；主线：情节围绕感情推进；没有感情线或可忽略选无",
    "主角起点": "开篇主角实力相对周围人的位置",
}

# How sub-genres that are easily confused differ.
SUBGENRE_NOTES: dict[str, str] = {
    "东方玄幻": "架空世界，斗气、武魂等非修仙体系；有炼气筑基金丹这套体系的归仙侠",
    "异世大陆": "主角从现实世界来到的架空大陆",
    "高武世界": "现代或近未来社会里武道、超凡公开化",
    "古典仙侠": "剑仙、神话、志怪气质的仙侠，洪荒封神也归这里",
    "幻想修仙": "架空世界里的修仙升级",
    "现代修真": "现代背景的修仙",
    "都市生活": "现代都市，没有超自然能力",
    "都市异能": "现代都市，主角有超能力或医术、相术、风水等玄术",
    "人间百态": "写实的时代叙事、家庭伦理、市井人生",
    "架空历史": "虚构朝代，或没写明朝代的古代；写明真实朝代就选对应朝代",
    "军旅特战": "当代军人、特种兵、兵王、佣兵的成长与作战",
    "未来科技": "未来或近未来背景，科技是主要看点；现代背景的黑科技归都市",
    "进化变异": "基因、进化、变异是主题，不以末世为主",
    "游戏异界": "游戏世界变成真实世界，或带着游戏能力到异界",
    "诡异神秘": "诡异复苏、规则怪谈、克苏鲁式的不可名状",
    "灵异民俗": "鬼怪、道士、民俗禁忌",
    "无限": "一个个独立副本，完成任务",
    "诸天": "穿梭多个已知作品或世界，不是副本制",
    "综漫": "穿梭的是动漫作品",
    "幻想言情": "古代或架空背景之外的幻想设定，感情线是主线",
}

# Other names of sub-genres.
SUBGENRE_ALIASES: dict[str, str] = {
    "修真文明": "幻想修仙", "神话修真": "幻想修仙", "异术超能": "都市异能",
    "军旅生涯": "军旅特战", "军事战争": "军旅特战", "特种兵": "军旅特战", "佣兵": "军旅特战",
    "超级科技": "未来科技", "未来世界": "未来科技", "古武机甲": "星际文明",
    "规则怪谈": "诡异神秘", "惊悚微恐": "诡异神秘", "仙侠奇缘": "幻想言情", "浪漫青春": "现代言情",
    "时代叙事": "人间百态", "家庭伦理": "人间百态", "古武未来": "武侠幻想", "武侠同人": "传统武侠",
    "神秘幻想": "史诗奇幻", "另类幻想": "史诗奇幻", "游戏主播": "虚拟网游", "官场": "官场仕途", "仕途": "官场仕途",
    "都市": "都市生活", "现代都市": "都市生活", "玄幻": "东方玄幻", "修仙": "幻想修仙", "仙侠": "幻想修仙",
    "末世": "末世危机", "无限流": "无限", "谍战": "谍战特工", "抗战": "抗战烽火", "网游": "虚拟网游", "电竞": "电子竞技",
}

# Other names of elements.
ELEMENT_ALIASES: dict[str, str] = {
    "空间": "随身空间", "随身农场": "随身空间", "系统流": "系统", "金手指": "系统",
    "都市异能": "异能", "异术超能": "异能", "超能力": "异能",
    "星际文明": "机甲星际", "机甲": "机甲星际", "星际": "机甲星际",
    "谍战特工": "谍战", "特工": "谍战", "军旅特战": "军旅", "特种兵": "军旅", "佣兵": "军旅", "兵王": "军旅",
    "商战职场": "商战", "职场": "商战", "创业": "商战",
    "综漫": "诸天", "二次元": "同人", "动漫": "同人",
    "末世危机": "末世", "规则怪谈": "克苏鲁诡异", "诡异": "克苏鲁诡异", "克苏鲁": "克苏鲁诡异",
    "灵异民俗": "鬼怪灵异", "灵异": "鬼怪灵异", "鬼怪": "鬼怪灵异", "中式恐怖": "鬼怪灵异",
    "侦探推理": "刑侦推理", "刑侦": "刑侦推理", "法医": "刑侦推理", "推理": "刑侦推理", "破案": "刑侦推理",
    "女装": "变身", "性转": "变身",
    "争霸": "争霸建国", "王朝争霸": "争霸建国", "建国": "争霸建国",
    "种田": "种田经营", "经营": "种田经营",
    "修真": "修仙", "修仙文明": "修仙",
    "网游": "游戏", "电竞": "游戏", "虚拟网游": "游戏",
    "娱乐明星": "娱乐圈", "文娱": "娱乐圈", "明星": "娱乐圈",
    "校园": "学院", "青春校园": "学院",
    "鉴宝": "玄学鉴宝", "风水": "玄学鉴宝", "玄学": "玄学鉴宝", "相术": "玄学鉴宝",
    "宫斗": "权谋", "朝堂": "权谋", "权谋争斗": "权谋", "官场": "权谋",
    "报仇": "复仇", "复仇打脸": "复仇", "扮猪吃老虎": "扮猪吃虎", "隐藏实力": "扮猪吃虎",
    "重生归来": "重生", "穿越重生": "穿越", "穿越者": "穿越",
    "盗墓": "盗墓探险", "探险": "盗墓探险",
    "美食文": "美食", "医生": "医术",
    "年代文": "年代",
}

# Names given as elements that are style options.
ELEMENT_TO_STYLE: dict[str, tuple[str, str]] = {"后宫": ("感情线", "多女主"), "多女主": ("感情线", "多女主"), "无感情线": ("感情线", "无"), "无女主": ("感情线", "无")}

# Neighbours of a term; checking one is an expansion of what was asked, nothing off the topic.
RELATED_TERMS: dict[str, tuple[str, ...]] = {
    "修仙": ("修真", "灵气", "飞升", "修炼", "修士", "仙侠", "修仙者"),
    "修真": ("修仙", "灵气", "飞升", "修炼", "修士"),
    "变身": ("性转", "变成女人", "女体化", "变女", "伪娘", "女装"),
    "穿越": ("重生", "现代", "前世", "穿书", "异世界", "穿越者", "穿越重生"),
    "重生": ("穿越", "前世", "重来", "回到过去", "穿越重生"),
    "系统": ("金手指", "外挂", "系统流", "面板", "任务奖励"),
    "金手指": ("系统", "外挂", "随身空间", "面板"),
    "直播": ("直播间", "主播", "弹幕"),
    "异能": ("超能力", "超能", "异能者"),
    "超能力": ("异能", "超能"),
    "僵尸": ("丧尸", "尸", "末世"),
    "丧尸": ("僵尸", "末世"),
    "兽人": ("兽族", "兽化", "妖兽"),
    "机甲": ("机器人", "机械", "高达"),
    "后宫": ("多女主", "种马"),
    "种马": ("后宫", "多女主"),
}

# What a card says of a trope: elements, sub-genres, genres, options of a style scale that mean yes, and
# scales of which only the ends decide (scale, yes, no).
TROPE_RULES: dict[str, dict] = {
    "后宫": {"style": ("感情线", ("多女主",))},
    "压抑": {"style": ("基调", ("沉重压抑",))},
    "搞笑": {"style": ("基调", ("轻松搞笑",))},
    "开局无敌": {"style": ("主角起点", ("开局无敌",))},
    "言情": {"genres": ("言情",), "style": ("感情线", ("单女主主线",))},
    "玄幻": {"genres": ("玄幻",)},
    "金手指": {"elements": ("系统", "随身空间", "重生")},
    "灵异": {"elements": ("鬼怪灵异",), "subgenres": ("灵异民俗",)},
    "超能力": {"elements": ("异能",), "subgenres": ("都市异能",)},
    "克苏鲁": {"elements": ("克苏鲁诡异",)},
    "争霸": {"elements": ("争霸建国",)},
    "爽文": {"scale": ("爽度", "高", "低")},
}

# Phrases by which an answer admits that it has no source.
ABSTAINS = (
    r"(未收录|没有收录|没被收录|不在摘要|摘要(里|中)?(没有|不包含|没收|未)|无法(回答|确认|查到|核实|定位)|没法(告诉|回答|讲|给你讲)|查不到"
    r"|没有(找到|查到|看到)(这|那)一?章|不在(收录|可查|覆盖|摘要)范围|不在(这些|被)?收录|只(摘要)?收录了|超出(了)?(摘要|收录)|没能定位|没有原文可依据|不想凭.{0,6}猜)"
)

# Shares of section kinds in a pooled vector.
KIND_WEIGHTS: dict[str, float] = {"blurb": 3.0, "titles": 3.0, "middle": 0.5}


@dataclass(frozen=True)
class Lexicon:
    """All vocabulary that the text operators take."""

    term_forms: dict[str, tuple[str, ...]] = field(default_factory=lambda: TERM_FORMS)
    meta_labels: tuple[str, ...] = META_LABELS
    negative_markers: tuple[str, ...] = ("不要", "避免", "不", "别", "无", "非")
    clause_markers: tuple[str, ...] = ("不要", "不看", "不想看", "不喜欢", "别推", "别来", "别给", "别带", "别有", "排除", "拒绝", "受不了", "讨厌")
    protagonist: str = "主角"
    separators: str = r"[\s\x{3000},，;；/、|]+"
    clause_ends: str = r"[，。；！？,.;!?\n]"
    sentence_ends: str = "。！？…”』」)）"
    sentence_breaks: str = r"(?<=[。！？!?…”』」])|(?<= / )"
    whole_title: str = "全文"
    chapter_heading: str = (
        r"^[\s\x{3000}]*(?:正文[\s\x{3000}]*)?(?:第[一二三四五六七八九十百千万零〇两\d]+[章节回集卷部篇]|Chapter\s+\d+)(?:[ \t\x{3000}、:：.-][^\n]{0,80})?[\s\x{3000}]*$"
    )
    chapter_counts: tuple[str, ...] = (
        r"(?mU)^\s*第[一二三四五六七八九十百千万零〇两\d]+[章回节集卷]\b",
        r"(?mU)^\s*正文\s*第[一二三四五六七八九十百千万零〇两\d]+章\b",
        r"(?miU)^\s*chapter\s+\d+\b",
    )
    ad_line: str = r"(?i)https?://\S+|www\.\S+|最新网址|最新章节|无弹窗|全文阅读|txt下载|请收藏本站|加入书签|手机用户请浏览|本书来自|起点中文网|纵横中文网|17K小说网|笔趣阁"
    boilerplate_edge: str = r"(?iU)知轩藏书|更多精校小说|zxcs8\.com|\bzxcs\b|精校小说下载"
    boilerplate_inner: str = r"(?i)知轩藏书|更多精校小说|zxcs8\.com|www\.zxcs|精校小说下载"
    ruler: str = r"^\s*[=\-*_＿—～＊]{8,}\s*$"
    edge_lines: int = 120
    blurb_marker: str = r"(?m)^[\s\x{3000}]*(?:内容简介|作品简介|文案|简介)[\s\x{3000}]*[:：]?[\s\x{3000}]*"
    finished: str = r"(全书完|全文完|全本完|大结局|正文完|本书完|（完）|\(完\)|完结)"
    endings: tuple[str, str] = ("完结标记", "无标记")
    side_titles: str = r"(番外|后记|感言|作者的话|完本|上架|请假|通知|公告|推荐)"
    related_terms: dict[str, tuple[str, ...]] = field(default_factory=lambda: RELATED_TERMS)


#: A Latin set for the driver's tables and for tests.
LATIN = Lexicon(
    term_forms={"system": ("the ", "system"), "travel": ("tion", "travel"), "school": ("und", "sch"), "love": ("que", "les "), "robot": ("robot",)},
    meta_labels=("harem", "boring"),
    negative_markers=("no ", "not", "un", "de"),
    clause_markers=("no ", "not ", "pas ", "nicht "),
    protagonist="tion",
    separators=r"[\s,;/|]+",
    clause_ends=r"[,.;!?\n]+",
    sentence_ends=".!?",
    sentence_breaks=r"(?<=[.!?])",
    whole_title="",
    chapter_heading=r"^[ \t]*(?:[A-Z][a-z]+)(?:[ \t:.-][^\n]{0,80})?[ \t]*$",
    chapter_counts=(r"(?m)^[A-Z][a-z]+ of\b", r"(?m)^The [a-z]+\b"),
    ad_line=r"(?i)https?://\S+|www\.\S+|cheap|click here",
    boilerplate_edge=r"(?i)licensed under|all rights reserved|released under",
    boilerplate_inner=r"(?i)all rights reserved",
    ruler=r"^[ ]*[=*_-]{8,}[ ]*$",
    edge_lines=3,
    blurb_marker=r"(?m)^[ ]*(?:The|Die|Le|La) +",
    finished="in\\.$|en\\.$",
    endings=("finished", "unknown"),
    side_titles="(?i)afterword|notice|side story",
    related_terms={"system": ("panel", "cheat"), "love": ("romance",)},
)
