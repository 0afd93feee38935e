"""Lists and patterns that decide what belongs in the catalogue.

They are data and must be as they are for the results to agree; nothing here
is computed.  Patterns are read without regard to case.
"""

#: Highest season number that is kept, and ratings that stand in for a missing Chinese title.
HIGHEST_SEASON = 10
ENOUGH_RATINGS = 50

#: Subject ids that are no Japanese series.
FOREIGN_SUBJECTS = (
    219760, 419219, 499548, 529532, 538958, 547751, 556595, 561911, 564419, 580662, 587898, 608842, 609708, 624845, 625477, 640936, 662513,
)
#: Subject ids that are no television series.
NON_TV_SUBJECTS = (285424, 292940, 293556, 316817, 442559, 457956)
#: Subject ids that a review has taken out.
REVIEWED_SUBJECTS = (
    154771, 186180, 217239, 223127, 223407, 226986, 227778, 230295, 231067, 231887, 231888, 233609, 236597, 237838, 238300, 238831, 239747, 239750, 239840, 239853, 239911, 240383, 240459, 241031,
    243923, 244900, 247549, 249245, 250558, 256278, 258390, 259070, 259135, 262384, 263756, 267412, 267481, 270636, 274222, 279468, 279470, 279473, 279713, 294292, 301776, 302446, 302447,
)

#: Brands from elsewhere.
FOREIGN_BRANDS = (
    r"south\s+park|paw\s+patrol|curtis|柯蒂斯总统|ninjago|lego|mickey|disney|迪士尼|ディズニー|miraculous|family\s+guy",
    r"marvel|iron\s*man|spider-?man|spidey|moon\s*girl|devil\s*dinosaur|superman|beast\s*boy|dc\s*metal",
    r"transformers|变形金刚|變形金剛|rick\s*and\s*morty|瑞克和莫蒂",
    r"sponge\s*bob|spongebob|海绵宝宝|海綿寶寶|patrick\s*star|派大星",
    r"paddington|帕丁顿熊|帕丁頓熊|octonauts|海底小纵队|海底小縱隊|wild\s*kratts|动物兄弟|動物兄弟",
    r"ghost\s+and\s+molly\s+mcgee|幽灵与莫莉|幽靈與莫莉|beyblade\s+burst\s+quadstrike",
    r"star\s*trek|星际迷航|星際迷航|blood\s+of\s+zeus|宙斯之血|smiling\s+friends|微笑朋友",
    r"smurfs?|schtroumpfs|蓝精灵|藍精靈|mermaid\s+magic|魔法美人鱼|blaze\s+and\s+the\s+monster\s+machines",
    r"sealook|pinkfong|baby\s*shark|grimsburg|wakfu|沃土|monster\s*high|怪物高中|primal|genndy\s+tartakovsky|samuel|nyaaaanvy",
)
#: Titles from elsewhere, the brands among them.
FOREIGN_TITLES = (
    r"中国之旅|国产|国创|大陆|台湾|香港",
    r"皮皮鲁|鲁西西|天才小鲁班|新西游|千秋诗颂|敦煌的故事|山海(?:精奇|传奇)",
    r"喜羊羊|灰太狼|猪猪侠|熊出没|熊熊帮帮团|大头儿子|小头爸爸|棉花糖和云朵妈妈",
    r"超变兽车侠|铠兽超人|传奇少年刘伯温|进化先锋|旋风战车队|篮球旋风|冰球旋风|爆裂飞车",
    r"节气密码|宁德山海|少年家国梦|书香少年|王应麟|幸福公寓|光影天炎战甲|青田小田鱼|孔子归来|飞越五千年|霸王龙雷奇|桃花夫人|快乐小郑星",
    r"龙族|龍族|Dragon\s+Raja",
    r"차징|탑스피너|티니핑|꼬마버스|타요|라바|爆笑虫子|小公交车太友|朱迪希猜谜秀",
    *FOREIGN_BRANDS,
)
#: Tags that name an origin elsewhere.
FOREIGN_TAGS = (
    r"^(?:中国|中国大陆|国产|国创|国产动画|中国动画|大陆动画|台湾动画|香港动画|美国|美国动画|欧美|欧美动画|英国|英国动画|法国|法国动画|加拿大|加拿大动画|韩国|韩产|韩国动画|韩产动画)$",
    r"中国动画|国产动画|欧美动画|美国动画|法国动画|加拿大动画|韩国动画|韩产动画",
)
#: What shows a Japanese production in spite of such tags.
JAPANESE_TAGS = r"日本动画|日本動畫|日本アニメ|japanese\s+animation|japan\s+animation|tokyo\s+mx|テレビ|テレ東|テレビ東京|nhk|bs11|at-x|toei|東映|aniplex|yostar\s*pictures"
#: Japanese studios.
JAPANESE_STUDIOS = (
    r"production\s*i\.?\s*g|signal\.?\s*md|mappa|ufotable|kyoto\s*animation|bones|wit\s*studio|a-?1\s*pictures|cloverworks|madhouse|j\.?\s*c\.?\s*staff|tms|olm|toei|sunrise|"
    r"bandai\s*namco\s*pictures|doga\s*kobo|動画工房|京都アニメーション|東映|サンライズ|日本アニメーション"
)
#: Japanese addresses and broadcasters.
JAPANESE_DOMAIN = r"\.jp(?:[/?#]|$)"
JAPANESE_BROADCASTERS = r"tv-tokyo|nhk|bs11|at-x|toei|shopro|vap\.co\.jp|tokyo-mx|mbs|tbs|fujitv|ytv|ntv|tv-asahi"
KANA = "[ぁ-ゖァ-ヺー]"
HANGUL = "[가-힯]"

#: What marks adult content.
ADULT = (
    r"r-?18|18\+|nsfw|adult|アダルト|成人|里番|裏番|僧侣档|僧侶枠|オンエア版|無修正|av女优|av女優|セックス|sex"
)
ADULT_TITLES = r"インゴクダンチ|淫狱团地|淫獄団地|xl\s*上司"
#: Films, specials, recaps and web series.
MOVIES = r"剧场版|劇場版|映画|movie|the\s+movie|film|电影|電影"
SPECIALS = r"テラパゴスのキラキラ探検記|太乐巴戈斯的闪闪发亮探险记|太樂巴戈斯的閃閃發亮探險記|terapagos"
NON_TV_TITLES = (
    r"ライジングインパクト|一击冲天|高尔夫物语|ばなにゃ\s*あらうんど\s*ざ\s*わーるど|香蕉喵\s*(?:第3期|游世界)|Shenmue the Animation|莎木|地球外少年少女|"
    r"バイオハザード[:：]\s*インフィニット\s*ダークネス|BIOHAZARD[:：]\s*Infinite Darkness|Resident Evil[:：]?\s*Infinite Darkness|生化危机[:： ]\s*无尽黑暗|"
    r"斉木楠雄のψ難\s*Ψ始動編|齐木楠雄的灾难\s*灾始动篇|ポケモン\s*ソード・シールド\s*薄明の翼|精灵宝可梦\s*剑&盾\s*薄明之翼|ベイブレードバースト\s*スパーキング|霸旋陀螺\s*爆刃对决\s*第5期|"
    r"四月一日さん家と\s*第2期|四月一日三姐妹\s*第2期|すとぷりのhere!we!go!!|草莓王子\s*herewego|おーばーふろぉ|overflow\.cf-anime\.com"
)
WEB_TITLES = r"t\s*[・･.]?\s*p\s*ぼん|ぶらどらぶ|vladlove|グリム組曲|格林童话变奏曲"
RECAPS = (
    r"tv\s*(?:剪辑版|編集版)|特别编集版|特別编集版|特別編集版|総集編|总集篇|粉丝来信|ファンレター|女英雄们的故事|女英雄たちの物語|奇蛋物语\s*特别篇|ワンダーエッグ.*特別編|柱合会议|蝶屋敷篇|浅草篇|鼓屋敷篇|"
    r"那田蜘蛛山篇|起始的物语|永远的物语|はじまりの物語|永遠の物語|在异世界获得超强能力的我.*sp|No\.?\s*170\s*[＋+]\s*1"
)
#: A season number in a title; the number is in group 1 or 2.
SEASON_NUMBER = r"(?:第\s*([0-9０-９一二三四五六七八九十百]+)\s*(?:[季期部]|シリーズ))|(?:season|series|s)\s*([0-9０-９]+)"

#: Keys of a subject's bag of facts.
ALIAS_KEYS = ("别名", "aliases", "Alias")
ENGLISH_KEYS = ("英文名", "English")
SITE_KEYS = ("官方网站", "官网", "公式サイト", "Official website")
STUDIO_KEYS = ("动画制作", "アニメーション制作", "制作公司", "studio")
WORK_KEYS = ("原作", "原作类型")
COUNTRY_KEYS = ("国家", "国家/地区", "地区", "产地", "製作国", "制作国", "制作国家", "动画制作国家", "Country")
MAKER_KEYS = ("国家", "国家/地区", "地区", "产地", "製作国家", "制作国家", "制作", "製作", "出品", "企画", "Country")

#: Words that say nothing in a title.
TITLE_NOISE = (r"\b(?:tv\s*anime|tv\s*アニメ|anime|animation|animated|放送版|完全新作)\b", r"(?:TV)?アニメ", r"動畫|动画|动畵")
#: Punctuation of titles, in matching and (three lists) in merging, reconciling and auditing.
TITLE_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~、。・「」『』【】（）［］〈〉《》！？：；，．〜～ー―－＝＋×✕"
MERGE_PUNCTUATION = "!！?？:：,，.。'\"“”‘’《》「」『』（）()[]_-"
AUDIT_PUNCTUATION = "!\"'`()[]{}<>.,:;?/\\_-"
#: Simplified characters and their traditional forms.
SIMPLIFIED = "间谍过家药屋少女的独语龙与国后发复见话总剧场"
TRADITIONAL = "間諜過家藥屋少女的獨語龍與國後發復見話總劇場"
#: Phrases of seasons and arcs.
FINAL_PHRASES = r"final\s*season|final|完结篇|完結編|完结|完結|最終章|终章|終章"
CLOSING_WORDS = r"完结篇|完結編|完结|完結|最終章|终章|終章|続編|续篇|續篇|新章"
SEQUEL_WORDS = r"続編|续篇|續篇|新章"
NUMERALS = "一二三四五六七八九"

#: Titles (and starts) whose subject is known.
KNOWN_SUBJECTS = (
    (322900, None, r"終末のワルキューレ|终末的女武神|Record of Ragnarok|Shuumatsu no (?:Walkure|Valkyrie)"),
    (308936, "2021-04-10", r"東京卍?リベンジャーズ|东京卍?复仇者|Tokyo Revengers"),
    (297969, "2020-10-01", r"ひぐらしのなく頃に|新\s*寒蝉鸣泣之时|寒蝉鸣泣之时\s*业"),
    (308558, "2021-04-01", r"シャーマンキング|新\s*通灵王|SHAMAN KING"),
    (306559, "2021-10-08", r"終末のハーレム|终末的后宫|World'?s End Harem"),
    (294288, "2021-04-04", r"キングダム\s*第3シリーズ|王者天下\s*第3期|Kingdom\s*(?:3rd|Third)"),
    (262940, "2020-01-10", r"とある科学の超電磁砲(?:レールガン)?T\.?|某科学的超电磁炮\s*(?:第3期|T)|Toaru Kagaku no Railgun T"),
)

#: Genres in the order that they are given in, and their words.
GENRES = {
    "恋爱": ("恋爱", "戀愛", "爱情", "愛情", "恋愛", "romance", "love", "ラブコメ"),
    "热血": ("热血", "熱血", "少年", "王道", "燃", "shonen", "shounen"),
    "搞笑": ("搞笑", "喜剧", "喜劇", "コメディ", "comedy"),
    "日常": ("日常", "生活", "slice of life"),
    "奇幻": ("奇幻", "魔法", "魔女", "魔王", "魔术", "魔術", "妖精", "ファンタジー", "fantasy"),
    "异世界": ("异世界", "異世界", "转生", "轉生", "転生", "isekai", "reincarnation"),
    "战斗": ("战斗", "戰鬥", "格斗", "格鬥", "バトル", "battle", "动作", "動作", "action", "剑", "劍", "剣", "刀", "忍者", "战争", "戰爭"),
    "冒险": ("冒险", "冒険", "adventure"),
    "校园": ("校园", "校園", "学园", "學園", "学校", "學校", "高校", "中学", "中學", "school"),
    "科幻": ("科幻", "sci-fi", "science fiction", "机战", "機戰", "机器人", "機器人", "ロボット"),
    "悬疑": ("悬疑", "懸疑", "推理", "侦探", "偵探", "ミステリー", "mystery", "suspense"),
    "运动": ("运动", "運動", "体育", "體育", "スポーツ", "sports"),
    "音乐": ("音乐", "音樂", "歌", "偶像", "アイドル", "music"),
    "治愈": ("治愈", "治癒", "癒し", "healing"),
    "百合": ("百合", "ガールズラブ", "girls love"),
    "BL": ("耽美", "轻bl", "輕bl", "boys love", "ボーイズラブ"),
    "子供向": ("子供向", "儿童", "兒童", "kids"),
}
