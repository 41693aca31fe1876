"""Word lists, patterns and tables that results depend on."""

# Legal-form suffixes that a comparison key leaves out.
COMPANY_SUFFIXES = [
    "股份有限公司", "有限責任公司", "有限公司", "合夥事業", "獨資商號", "企業社", "工作室", "商行", "行號", "公司",
    "co., ltd.", "co.,ltd.", "co ltd", "company limited", "limited", "corporation", "corp.", "corp", "inc.", "inc", "ltd.", "ltd", "llc", "gmbh",
]
# Words that mark a company's name.
COMPANY_MARKERS = [
    "股份有限公司", "有限公司", "無限公司", "兩合公司", "企業社", "實業社", "工業社", "商號", "行號", "工作室", "合作社", "產銷班", "事務所",
    "co., ltd", "co.,ltd", "co ltd", "company limited", "corporation", "corp.", "inc.", "ltd.", "llc", "gmbh",
]
# Legal forms in brackets within a name.
BRACKETED_FORM = r"[（(]\s*(股|有|無)\s*[)）]"
# Area codes, longest first.
AREA_CODES = ["0836", "0826", "089", "082", "049", "037", "02", "03", "04", "05", "06", "07", "08"]
# Query parameters that only track visits, by prefix.
TRACKING_PARAMETERS = ["utm_", "fbclid", "gclid", "mc_cid", "mc_eid", "_ga"]
# Domains of error trackers, and of examples and placeholders.
TRACKING_DOMAINS = [
    "sentry.io", "sentry.wixpress.com", "wixpress.com", "sentry-next.wixpress.com", "bugsnag.com", "rollbar.com", "newrelic.com",
    "datadoghq.com", "sentry.local", "logrocket.com", "raygun.io",
]
PLACEHOLDER_DOMAINS = [
    "example.com", "example.org", "example.net", "example.tw", "domain.com", "yourdomain.com", "yourcompany.com", "mydomain.com",
    "email.com", "test.com", "sample.com", "schema.org", "w3.org", "localhost", "sentry.local",
]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".bmp"]
ROLE_LOCAL_PARTS = [
    "admin", "info", "sales", "service", "support", "contact", "office", "webmaster", "postmaster", "noreply", "no-reply",
    "donotreply", "marketing", "hr", "billing", "help", "enquiry", "enquiries",
]
# Cells that are parts of a table and no company.
NOT_A_COMPANY = [
    "合計", "總計", "小計", "總和", "總數", "累計", "共計", "以上", "備註", "說明", "附註", "註", "其他", "無", "未填", "從缺",
    "n/a", "na", "-", "--", "null", "none", "公司名稱", "廠商名稱", "工廠名稱", "企業名稱", "名稱", "公司", "廠商",
    "company", "company name", "name", "total", "subtotal", "remark", "note",
]
NO_WEBSITE = ["n/a", "na", "none", "-", "無", "沒有"]
TAX_ID_WEIGHTS = [1, 2, 1, 2, 1, 2, 4, 1]
# Words of a registration status that say the company is gone.
DEAD_STATUS_WORDS = ["解散", "撤銷", "廢止", "註銷", "清算", "停業"]
EMAIL_POINTS = {"Valid": 40, "Unknown": 28, "Empty": 0, "Invalid Syntax": 5, "Disposable": 5, "No MX": 5}
CAPITAL_POINTS = [(100_000_000, 15), (10_000_000, 12), (1_000_000, 8), (1, 4)]
FRESHNESS_POINTS = [(30, 10), (90, 7), (365, 4)]
PRESENCE_POINTS = {"phone": 20, "website": 5, "contact_person": 5, "address": 3, "tax_id": 2}
SCORE_CEILING_GONE = 10
ARTICLE_HOST_PREFIXES = ["life.", "blog.", "news.", "article.", "media.", "event."]
ARTICLE_PATH_PARTS = [
    "/article/", "/articles/", "/blog/", "/news/", "/post/", "/posts/", "/story/", "/column/", "/promotion/", "/ad/", "/ads/",
    "/event/", "/knowledge/", "/faq/", "/tips/",
]
HEADLINE_PATTERNS = [
    "[?？]", "[!！]{1,}$", "懶人包|攻略|推薦|排行|排名|評比|解析|指南|教學|一次看|報你知", "怎麼[選辦做用挑放]|如何[選挑做用]|要注意什麼|該不該|值不值得",
    "幾種|大重點|大迷思|個理由|個技巧|步驟教學", "價格|費用|多少錢|行情|房價|優惠|折扣|免費", "^\\d{4}\\s*年?[最新推薦]",
]
# What people write who want no more mail, and what marks an answer that no person wrote. The body counts by its first characters.
UNSUBSCRIBE_WORDS = [
    "退訂", "取消訂閱", "取消電子報", "請勿再寄", "不要再寄", "不要再發", "停止寄送", "停寄", "勿再來信", "移除我", "從名單移除",
    "unsubscribe", "remove me", "opt[\\s-]?out", "take me off", "stop emailing",
]
UNSUBSCRIBE_BODY_CHARS = 400
AUTO_SUBJECT_WORDS = ["自動回覆", "自动回复", "外出", "休假中", "out of office", "auto[\\s-]?reply", "automatic reply"]
AUTO_PRECEDENCE = ["bulk", "auto_reply", "junk"]
# Parts of a name that say company: anywhere, at the end of names of four characters or more that are no address, and in Latin names.
NAME_MARKERS = [
    "股份有限公司", "有限公司", "公司", "企業社", "企業", "實業", "工業", "科技", "商行", "行號", "工作室", "事務所", "工廠", "製造", "貿易",
    "合作社", "農場", "牧場", "診所", "藥局", "商號", "產業", "集團",
]
NAME_MARKERS_LATIN = ["co.", "co,", " ltd", "ltd.", " inc", "inc.", "corp", "company", "llc", "gmbh", "plc", "industries", "enterprise"]
NAME_ENDINGS = ["行", "廠", "店", "社", "號", "坊", "館", "苑", "軒", "堂", "舖", "鋪", "庄"]
# Labels of records by field, without white space and marks, in lower case; labels that are none; labels whose value is a person.
LABELS = {
    "company_name": ["公司名稱", "廠商名稱", "會員名稱", "商號名稱", "企業名稱", "公司行號", "單位名稱", "中文名稱", "名稱", "companyname", "company", "name"],
    "english_name": ["英文名稱", "英文公司名稱", "公司英文名稱", "英文", "englishname", "english"],
    "tax_id": ["統一編號", "統編", "公司統編", "營利事業統一編號", "稅籍編號", "taxid", "vatno", "vat"],
    "email": ["email", "電子郵件", "電子信箱", "電子郵箱", "信箱", "電郵", "郵件", "mail"],
    "phone": ["電話", "聯絡電話", "連絡電話", "公司電話", "電話號碼", "服務電話", "tel", "telephone", "phone", "telno"],
    "fax": ["傳真", "傳真號碼", "公司傳真", "聯絡傳真", "連絡傳真", "fax", "faxno"],
    "website": ["網址", "公司網址", "網站", "官網", "公司網站", "website", "url", "web", "homepage"],
    "address": ["地址", "公司地址", "通訊地址", "營業地址", "聯絡地址", "廠址", "住址", "address"],
    "industry": ["營業範圍", "行業別", "產業別", "業別", "所屬產業", "所屬行業", "行業", "產業類別", "industry"],
    "products": ["主要產品", "產品項目", "營業項目", "經營項目", "主要業務", "產品類別", "代理廠商及代銷產品", "代理品牌", "代銷產品", "products", "product"],
    "contact_person": ["負責人", "負責人姓名", "代表人", "聯絡人", "董事長", "業務聯絡人", "聯絡窗口", "窗口", "contactperson", "contact"],
}
NO_LABELS = ["註", "備註說明", "說明", "提醒", "注意", "警告", "查詢", "搜尋", "note", "warning", "error"]
PERSON_LABELS = ["會員代表", "代表人", "負責人", "董事長", "總經理"]
LONGEST_LABEL, LONGEST_VALUE = 20, 500
# CJK characters; a label before a full-width colon, or before a colon with a blank or the end behind; marks that labels are compared without.
CJK = "㐀-䶿一-鿿豈-﫿"
LABEL = r"(?:(?<=\s)|^)([^\s：︰:]{1,24})\s?(?:[：︰]|:(?=[ \t\r\n]|$))"
LABEL_MARKS = r"[\s　*※•·・\-_()（）\[\]【】]"
# Classes that rows take turns with, or that mark a place in a list: they tell nothing about what an element is.
ALTERNATING_CLASSES = ["odd", "even", "alt", "altrow", "alternate", "stripe", "striped", "row-odd", "row-even", "first", "last", "active"]
# What a link to the next page of a list says.
NEXT_PAGE_WORDS = ["下一頁", "下一页", "下頁", "次頁", "更多", "next", "next page", ">", ">>", "›", "»"]
# Words that a header of names of companies holds, and words that rule it out.
NAME_HEADER_HINTS = ["公司", "廠商", "企業", "名稱", "company"]
# Patterns that both Java and other engines read alike.
EMAIL_IN_TEXT = r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)+"
# A telephone number in running text: area codes in brackets may hold blanks, and an extension belongs to it.
PHONE_WITH_EXTENSION = r"(?<![0-9])(?:\+886[\s-]?|\(\s*0[0-9]{1,3}\s*\)\s*|0)[0-9]{1,3}[\s-]?[0-9]{3,4}[\s-]?[0-9]{3,4}(?:\s*(?:#|轉|分機)\s*[0-9]{1,6})?(?![0-9])"
PHONE_IN_TEXT = r"(?:\+886[\s-]?|\(0\d{1,2}\)|0)\d{1,3}[\s)-]?\d{3,4}[\s-]?\d{3,4}"
EMAIL = r"^[a-z0-9!#$%&'*+/=?^_`{|}~\-]+(?:\.[a-z0-9!#$%&'*+/=?^_`{|}~\-]+)*@(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"
WEBSITE = r"^https?://(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}(?::[0-9]{1,5})?(?:/[^\s]*)?$"
PHONE = r"^\+?[0-9\-]{7,20}(?:#[0-9]{1,6})?$"
