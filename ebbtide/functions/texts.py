"""Wording and number formats of the texts sent to readers.

Fixed values: these strings are the output format.
"""

FILTER_LABELS = {
    "bollinger": "بولينجر السفلي",
    "rsi": "RSI تشبع بيعي",
    "support": "منطقة دعم",
    "wedge": "وتد هابط",
}
TOO_FEW_BARS = "بيانات غير كافية"
LOWER_BAND = "الحد السفلي "
SUPPORT_AT = "دعم عند "
SUPPORT_FEW_LOWS = "لا توجد قيعان كافية"
SUPPORT_FAR = "بعيد عن الدعم"
FILTER_FAILED = "خطأ"
WEDGE_REASONS = {
    "no_pivots": "لا توجد قمم/قيعان كافية",
    "too_short": "النموذج قصير جداً",
    "not_falling": "لا يوجد وتد هابط",
    "crossed": "الخطوط تقاطعت",
    "outside": "السعر خارج الوتد",
    "wedge": "وتد هابط مكتمل التكوين",
}
MATCHED_MARK, MISSED_MARK = "✅", "❌"
BEST_CALL_TITLE = "  📊 أفضل عقد CALL 🟢📈:"
STRIKE, EXPIRES, DAYS, PREMIUM, PER_CONTRACT = "تنفيذ ", " • ينتهي ", " يوم", " • بريميوم ", "$/عقد"
DELTA, THETA, THETA_UNIT = "دلتا=", "ثيتا=", "$/يوم"
BREAKEVEN_LINE, BREAKEVEN_TAIL = "    نقطة التعادل: ", " • تعادل "
ESTIMATED_NOTE = "  (≈ آخر سعر تداول — سوق الأوبشنز مغلق الآن)"
RELAXED_NOTE = "  ⚠️ شروط مخففة: لم يتوفر عقد يحقق الشروط المثالية"
NO_OPTIONS = "  📊 لا يوجد أوبشن لهذا السهم"
DECLINE, IN_SESSIONS, BELOW_AVERAGE = "هبوط ", " في 20 جلسة", "تحت متوسط 50 يوم"
ABOVE_LOW, BELOW_HIGH = " • فوق قاع 52 أسبوع بـ", " • تحت القمة بـ"
HISTORY, WITHIN, SESSIONS_IN, OUT_OF, SIMILAR = (
    "    📈 تاريخياً: ارتد ≥", " خلال ", " جلسة في ", " من ", " مرة مشابهة (متوسط أعلى ارتداد ")
ALERT_HEADER = "⚡ إشارة فورية — 📈 احتمال صعود"
ALERT_FOOTER = "⚠️ تحليل فني آلي — ليس توصية بشراء أو بيع"
EMPTY_SOURCE = "(لا توجد)"
EXPIRY_NOTICE = "⏰ انتهت مدة اشتراكك وتوقفت التنبيهات. "
REPORT_TITLE = "📊 سجل أداء الإشارات (السهم مقابل المؤشر):"
REPORT_AFTER, REPORT_SIGNALS, REPORT_WON, REPORT_MEAN = (
    "  بعد ", " ساعة: ", " إشارة • تفوق على السوق في ", "% منها • متوسط الفارق ")
REPORT_NONE = "📊 لا توجد نتائج مؤكدة بعد"
REPORT_PENDING_HEAD, REPORT_PENDING_TAIL = "⏳ ", " إشارة قيد المتابعة (لم يحن وقت تقييمها بعد)"
COMPACT_HEAD, COMPACT_LAST, COMPACT_AFTER, COMPACT_HOURS = (
    "📊 سجل الأداء: تفوق على السوق في ", "% من آخر ", " إشارة (بعد ", " ساعة)")
