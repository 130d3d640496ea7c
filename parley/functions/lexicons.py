"""Word lists and patterns of the rules.

Fixed values: they must be what they are for results to agree. Every operator takes a
Lexicon, so that other vocabularies can be used with the same rules.
"""

from __future__ import annotations

from dataclasses import dataclass

# Risk groups.
RISK = {
    "price": ("价格", "价钱", "多少钱", "报价", "优惠", "折扣", "便宜", "贵", "付款", "定金"),
    "inventory": ("库存", "现货", "缺货", "有货", "补货"),
    "refund": ("退款", "退钱", "退货", "撤销", "取消订单"),
    "compensation": ("赔偿", "赔付", "补偿", "红包"),
    "logistics": ("物流", "快递", "单号", "发货", "签收", "派送", "丢件"),
    "delivery_promise": ("保证到", "一定到", "肯定到", "今天到", "明天到", "准时到"),
    "complaint": ("投诉", "欺骗", "骗人", "曝光", "差评", "维权"),
    "quality": ("破损", "损坏", "坏了", "质量", "瑕疵", "少件", "错发", "漏发"),
}
# After-sales incidents by priority, and what closes them.
P0 = ("退款", "退钱", "投诉", "维权", "欺骗", "骗人", "曝光", "差评")
P1 = ("破损", "损坏", "坏了", "质量", "瑕疵", "错发", "漏发", "少件", "物流异常", "没收到", "丢件")
P2 = ("物流", "快递", "发货", "到哪", "单号", "签收", "售后", "退换")
CLOSURE = ("解决了", "收到了", "没问题了", "可以了", "好的谢谢", "谢谢处理")
PRESALES = ("想要", "想买", "下单", "购买", "多少钱", "价格", "报价", "有货", "库存", "怎么订", "付款")
# Words of the opportunity score and of the memory.
PURCHASE = ("想要", "想买", "下单", "购买", "怎么订", "付款", "定金", "订一个")
PRICE = ("多少钱", "价格", "报价", "优惠", "便宜", "预算")
URGENCY = ("今天", "明天", "尽快", "急", "马上", "什么时候能", "来得及")
REPEAT = ("再来", "再买", "回购", "还是之前", "又要", "老样子")
REJECTION = ("不需要", "不用了", "不买", "算了", "暂时不要", "已经买了")
OBJECTION = ("太贵", "考虑一下", "担心", "但是", "能便宜", "预算", "不确定")
PREFERENCE = ("喜欢", "想要", "不要", "颜色", "款式", "尺寸", "偏好")
COMMITMENT = ("我帮你", "给你查", "稍后", "等我", "马上处理", "会给", "可以安排")
QUESTION = ("?", "？", "吗", "怎么", "什么", "多少", "能不能")
OPEN_QUESTION = ("?", "？", "吗", "怎么", "多少", "能不能")
LOW_VALUE = ("嗯", "恩", "哦", "好", "好的", "行", "可以", "收到", "知道了", "谢谢", "不客气", "哈哈", "？", "?")

# Redaction patterns in order, by label.
REDACTIONS = (
    ("address", r"(?:详细地址|收货地址|所在地区)\s*[:：]\s*[^，,。；;\n]{1,80}"),
    ("phone", r"(?:手机号码|联系电话|联系电话号码)\s*[:：]\s*[^，,。；;\n]{1,40}"),
    ("person_name", r"(?:联系人|收件人|姓名)\s*[:：]\s*[^，,。；;\n]{1,24}"),
    ("id_card", r"(?<!\d)\d{17}[0-9Xx](?!\d)"),
    ("address", r"(?:[一-鿿]{2,}(?:省|自治区|市|自治州|县|区)){1,4}[一-鿿A-Za-z0-9-]{0,30}(?:街道|镇|乡|路|街|巷|小区|村|号|栋|幢|单元|室)[一-鿿A-Za-z0-9-]{0,20}"),
    ("person_name", r"(?:收件人|联系人|姓名)\s*[:：]?\s*[一-鿿·]{2,8}"),
    ("person_name", r"[一-鿿·]{2,6}(?:先生|女士|老师|老板)(?![一-鿿])"),
    ("phone", r"(?<!\d)1[3-9]\d{9}(?!\d)"),
    ("phone", r"(?<!\d)(?:0\d{2,3}[- ]?)?\d{7,8}(?!\d)"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("url", r"(?i)https?://[^\s]+"),
    ("wechat_id", r"(?i)(?:(?:微信|wx|wechat)(?:号|id)?\s*[:：]?\s*)[A-Za-z][-_A-Za-z0-9]{5,19}"),
    ("money", r"(?<!\d)(?:¥|￥)?\d+(?:\.\d{1,2})?\s*(?:元|块|rmb|RMB)"),
    ("date", r"(?<!\d)(?:20\d{2}[-/.年])?\d{1,2}[-/.月]\d{1,2}(?:日|号)?(?!\d)"),
    ("tracking_or_order_id", r"(?<![A-Za-z0-9])[A-Za-z]{0,4}\d[A-Za-z0-9-]{9,23}(?![A-Za-z0-9])"),
    ("inventory_state", r"(?:有现货|现货充足|有货|没货|无货|缺货|补货中|正在补货)"),
    ("logistics_state", r"(?:已经?|刚刚)?(?:发货|揽收|派送|签收|退回|拦截)(?:了|中)?"),
    ("refund_decision", r"(?:可以|不能|不支持|同意|会|马上|现在)?(?:给您|给你)?(?:退款|退钱|退货退款)"),
    ("delivery_promise", r"(?:保证|肯定|一定)(?:可以|会|能)?[^，。！？\n]{0,12}(?:到|送达|收到)"),
)
LABELS = {
    "id_card": "[身份证]", "address": "[地址]", "person_name": "[姓名]", "phone": "[手机号]", "email": "[邮箱]", "url": "[链接]", "wechat_id": "[微信号]",
    "money": "[金额]", "date": "[日期]", "tracking_or_order_id": "[单号]", "inventory_state": "[库存状态]", "logistics_state": "[物流状态]",
    "refund_decision": "[退款结论]", "delivery_promise": "[时效承诺]",
}
LOOSE_ADDRESS = r"[^，。！？\n]{0,40}(?:省|市|区|县|镇|街道|路|号|小区|楼|室)[^，。！？\n]{0,40}"
MOBILE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
NUMERIC_TRACKING = r"(?<!\d)\d{10,24}(?!\d)"
ALPHANUM_TRACKING = r"(?<![A-Za-z0-9])[A-Za-z]{1,5}\d{7,24}(?![A-Za-z0-9])"
TOKEN = r"[A-Za-z0-9_\-]+|[一-鿿]"
# Keys of JSON objects that are never shown; words of questions that only current facts can answer.
SENSITIVE_KEY = r"(?i)(?:phone|mobile|wxid|wechat(?:_?id)?|conversation_username|username|avatar|headimg|source_file)"
DYNAMIC_FACT = (
    "价格", "价钱", "多少钱", "库存", "现货", "缺货", "到货", "发货", "物流", "快递", "运单", "退款", "退货", "补发", "赔付", "赔偿", "优惠", "折扣", "price", "stock", "refund",
    "shipping"
)
OPEN_RETURN = ("处理中", "待处理", "未完成", "进行中", "open", "pending")
REFUND_TYPES = {"取消": "cancel", "退": "return", "退芋圆": "return_taro", "换": "exchange", "补": "compensation"}


@dataclass(frozen=True)
class Lexicon:
    """Words of the scoring rules; the default is the fixed vocabulary."""

    purchase: tuple = PURCHASE + PRICE
    urgency: tuple = URGENCY
    repeat: tuple = REPEAT
    rejection: tuple = REJECTION
    objection: tuple = OBJECTION
    preference: tuple = PREFERENCE
    commitment: tuple = COMMITMENT
    question: tuple = QUESTION
    open_question: tuple = OPEN_QUESTION
    low_value: tuple = LOW_VALUE
    p0: tuple = P0
    p1: tuple = P1
    p2: tuple = P2
    closure: tuple = CLOSURE
    presales: tuple = PRESALES
    risk: tuple = tuple(RISK.items())
