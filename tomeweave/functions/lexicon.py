"""Word lists and weights of the analyser."""

from __future__ import annotations

# Domain terms (term, weight, type).
DOMAIN = (
    ("数据上送", 1.50, "domain"), ("上送异常", 1.40, "domain"), ("报文解析", 1.50, "domain"), ("倒排索引", 1.50, "domain"), ("向量检索", 1.50, "domain"), ("相关性评价", 1.50, "domain"),
    ("冻结结算", 1.50, "domain"), ("费控下发", 1.50, "domain"), ("DLMS", 1.50, "identifier"), ("COSEM", 1.50, "identifier"), ("HLS5", 1.50, "identifier"), ("GMAC", 1.50, "identifier"),
)
# Words of no weight, of less weight, and never suppressed.
HARD = tuple("的 了 着 呢 吧 这个 那个 这些 那些 以及 并且 而且 此外 例如 比如".split())
SOFT = {"系统": 0.35, "项目": 0.30, "文档": 0.30, "相关": 0.25, "进行": 0.20, "实现": 0.35, "支持": 0.40, "功能": 0.35, "处理": 0.45, "数据": 0.55, "文件": 0.50, "配置": 0.55, "模块": 0.50, "接口": 0.60}
PROTECTED = tuple("不 未 无 非 无法 不能 失败 异常 错误 超时 中断 丢失 缺失 重复 删除 停止 启动 关闭 开启 增加 减少 大于 小于 同步 异步 回滚 阻塞 不存在 找不到".split())
# Weights by kind of token, limits, and fields where words of less weight count for more.
WEIGHTS = {"dictionary": 1.0, "identifier": 1.5, "bigram": 0.2, "unigram": 0.5, "protected": 1.3}
LEAST_WEIGHT, MOST_WEIGHT, RELIEF = 0.05, 2.0, 0.5
RELIEF_FIELDS = ("title", "path", "headings", "tags")
# Ranking constants and field weights.
K1, B, NOISE_SHARE = 1.5, 0.75, 0.8
FIELD_WEIGHTS = {"title": 3.0, "path": 2.5, "headings": 2.0, "tags": 1.8, "aliases": 1.8, "concepts": 1.6, "keywords": 1.5, "normalizedText": 1.2, "body": 1.0}
LEXICAL_LEAST, LEXICAL_MOST = 0.15, 1.8
# Words that are no keywords.
NO_KEYWORDS = tuple("可以 一个 这个 不是 还是 如果 因为 所以 但是 而且 或者 以及 就是 没有 已经 什么 怎么 这样 那样 时候 问题 需要 通过 进行 使用 用于 可能 应该 然后 the and for from with that this are not but has was".split())
# Embedding models (id, dimensions, most tokens).
MODELS = (("bge-base-zh-v1.5", 768, 512), ("bge-m3", 1024, 8192), ("paraphrase-multilingual", 384, 128))
# Scripts that are segmented, and characters of identifiers.
CJK = "㐀-䶿一-鿿豈-﫿\U00020000-\U0002a6df\U0002f800-\U0002fa1f"
RUN = "[A-Za-z0-9_./-]+"


def lexicon(path: str) -> list[tuple[str, float, str]]:
    """Domain terms from a tab-separated file (term, weight, type); weights are kept within 0.05 and 2."""
    rows = []
    with open(path, encoding="utf-8") as file:
        for line in file:
            cells = [c.strip() for c in line.rstrip("\n").split("\t")]
            if len(cells) < 2 or not cells[0] or cells[0].startswith("#") or cells[0] == "term":
                continue
            try:
                weight = float(cells[1])
            except ValueError:
                continue
            rows.append((cells[0], min(MOST_WEIGHT, max(LEAST_WEIGHT, weight)), cells[2] if len(cells) > 2 else "domain"))
    return rows
