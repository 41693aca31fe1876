"""Stored values as people read them, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Labels by kind, stored value and label.
LABELS = {
    "stage": {"New": "新名單", "Qualified": "已評估", "Contacted": "已聯絡", "Meeting": "已會面", "Proposal": "已報價", "Negotiation": "議價中", "Won": "已成交", "Lost": "已失單", "Inactive": "暫不往來"},
    "status": {"Active": "使用中", "Duplicate": "重複", "Invalid": "無效", "Archived": "已封存"},
    "priority": {"Low": "低", "Medium": "中", "High": "高", "Urgent": "緊急"},
    "activity": {"Note": "備註", "Call": "電話", "Email": "郵件", "Meeting": "會議", "Stage Change": "階段變更", "System": "系統"},
    "verdict": {"Unknown": "未檢查", "Empty": "無信箱", "Invalid Syntax": "格式錯誤", "Disposable": "拋棄式信箱", "No MX": "查無 MX", "Valid": "有效"},
    "run": {"Pending": "等待中", "Running": "執行中", "Success": "成功", "Partial": "部分成功", "Failed": "失敗", "Cancelled": "已取消"},
    "log": {"crawl": "爬取", "database": "資料庫", "export": "匯出", "gui": "介面", "error": "錯誤"},
    "format": {"excel": "Excel 活頁簿 (.xlsx)", "csv": "CSV 逗號分隔 (.csv)", "json": "JSON (.json)"},
}
FIELDS = {
    "id": "編號", "company_name": "公司名稱", "tax_id": "統一編號", "email": "電子信箱", "phone": "電話", "website": "網站", "address": "地址", "industry": "產業", "english_name": "英文名稱", "fax": "傳真",
    "products": "主要產品", "contact_person": "聯絡人", "pipeline_stage": "業務階段", "priority": "優先度", "status": "狀態", "email_verdict": "信箱驗證", "tags": "標籤", "source": "資料來源", "source_url": "來源網址",
    "follow_up_date": "追蹤日期", "created_at": "建立時間", "updated_at": "更新時間", "remark": "備註", "lead_score": "名單品質", "registration_status": "登記狀態", "capital_amount": "資本額",
    "registration_checked_at": "登記查詢時間", "do_not_contact": "不再聯絡", "name": "姓名", "title": "職稱", "mobile": "手機", "is_primary": "主要聯絡人", "company_id": "公司編號", "type": "類型",
    "subject": "主旨", "body": "內容", "occurred_at": "發生時間", "filename": "檔名", "size_bytes": "大小", "uploaded_at": "上傳時間",
}
ALL = "全部"


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _known(kind: str | None) -> dict[str, str]:
    """The labels of a kind; of all kinds the first that has a value."""
    if kind is not None:
        return LABELS[kind]
    out: dict[str, str] = {}
    for each in LABELS.values():
        out = each | out
    return out


def label_of(c: Column | str, kind: str | None = None) -> Column:
    """The label of a stored value: of its kind, or of whatever kind has it. An unknown value is its own label, null is empty."""
    return F.coalesce(F.try_element_at(_table(_known(kind)), col(c)), col(c), F.lit(""))


def value_of(c: Column | str, kind: str | None = None) -> Column:
    """The stored value of a label; null, empty and the label of all are empty, an unknown label is its own value. Of all kinds the last that has a label."""
    pairs = {label: value for each in ([LABELS[kind]] if kind else LABELS.values()) for value, label in each.items()}
    x = F.coalesce(col(c), F.lit(""))
    return F.when(x.isin("", ALL), "").otherwise(F.coalesce(F.try_element_at(_table(pairs), x), x))


def options(kind: str, with_all: bool = False) -> list[str]:
    """The labels to choose from, in order."""
    return [ALL] * with_all + list(LABELS[kind].values())


def field_label(name: str) -> str:
    return FIELDS.get(name, name)
