"""Job parameters with their default values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class NormaliseParams:
    accepted_order_statuses: tuple[str, ...]
    accepted_cart_statuses: tuple[str, ...] | None = None
    rejected_line_statuses: tuple[str, ...] = ()
    max_products: int = 50
    window_from: str | None = None
    window_to: str | None = None
    allow_anonymous: bool = True

    def __post_init__(self) -> None:
        if not self.accepted_order_statuses:
            raise ValueError("at least one accepted order status is needed")
        for name in ("accepted_order_statuses", "accepted_cart_statuses", "rejected_line_statuses"):
            values = getattr(self, name) or ()
            if any(not v.strip() for v in values) or len(set(values)) != len(values):
                raise ValueError(f"{name} must hold distinct, non-empty values")
        if not 2 <= self.max_products <= 500:
            raise ValueError("max_products must be between 2 and 500")
        if self.window_from and self.window_to and self.window_from > self.window_to:
            raise ValueError("window_from must not be after window_to")


@dataclass(frozen=True)
class PairParams:
    min_joint_count: int = 2
    min_confidence: float = 0.0
    min_lift: float = 1.0
    max_per_source: int = 50

    def __post_init__(self) -> None:
        if self.min_joint_count < 1 or self.max_per_source < 1:
            raise ValueError("counts must be positive")
        if not 0 <= self.min_confidence <= 1 or self.min_lift < 0:
            raise ValueError("thresholds out of range")


@dataclass(frozen=True)
class ReliabilityParams:
    confidence_weight: float = 0.5
    lift_weight: float = 0.25
    support_weight: float = 0.1
    joint_count_weight: float = 0.15
    joint_count_scale: float = 10.0

    def __post_init__(self) -> None:
        weights = (self.confidence_weight, self.lift_weight, self.support_weight, self.joint_count_weight)
        if any(w < 0 for w in weights):
            raise ValueError("weights must not be negative")
        if abs(sum(weights) - 1) > 1e-9:
            raise ValueError("weights must sum to 1")
        if self.joint_count_scale <= 0:
            raise ValueError("scale must be positive")


@dataclass(frozen=True)
class ValidationParams:
    min_reliability: float = 0.3
    reject_negative_association: bool = True
    tolerance: float = 1e-12


@dataclass(frozen=True)
class EligibilityParams:
    exclude_cart: bool = True
    exclude_purchased: bool = False
    exclude_out_of_stock: bool = True
    reject_unknown_compatibility: bool = False


@dataclass(frozen=True)
class AffinityParams:
    interest_days: int = 30
    rejection_days: int = 180
    # fixed values: signal weights
    direct_purchase: float = 0.2
    category_purchase: float = 0.1
    brand_purchase: float = 0.05
    product_interest: float = 0.25
    category_interest: float = 0.1
    owned_compatible: float = 0.15
    repeat_purchase: float = 0.1
    spend_fit: float = 0.05
    product_rejection: float = 0.5
    category_rejection: float = 0.25
    evidence_for_high: int = 3
    evidence_for_medium: int = 2

    def positive_weights(self) -> dict[str, float]:
        return {
            "DIRECT_PRODUCT_PURCHASE": self.direct_purchase,
            "CATEGORY_PURCHASE": self.category_purchase,
            "BRAND_PURCHASE": self.brand_purchase,
            "RECENT_PRODUCT_INTEREST": self.product_interest,
            "RECENT_CATEGORY_INTEREST": self.category_interest,
            "OWNED_COMPATIBLE_PRODUCT": self.owned_compatible,
            "REPEAT_PURCHASE_PATTERN": self.repeat_purchase,
            "OBSERVED_SPEND_FIT": self.spend_fit,
        }

    def penalties(self) -> dict[str, float]:
        return {
            "PRODUCT_REJECTION": self.product_rejection,
            "CATEGORY_REJECTION": self.category_rejection,
        }

    def __post_init__(self) -> None:
        if self.evidence_for_high < self.evidence_for_medium:
            raise ValueError("high confidence needs at least the medium evidence")
        if sum(self.positive_weights().values()) <= 0:
            raise ValueError("one positive weight must be above zero")


@dataclass(frozen=True)
class PersonalParams:
    commercial_weight: float = 0.7
    affinity_weight: float = 0.3
    multipliers: dict[str, float] = field(
        default_factory=lambda: {"none": 0.0, "low": 0.35, "medium": 0.7, "high": 1.0}
    )
    preference_boost: float = 0.1
    product_rejection: float = 1.0
    category_rejection: float = 0.25
    min_score: float = 0.0
    max_results: int | None = None

    def __post_init__(self) -> None:
        if abs(self.commercial_weight + self.affinity_weight - 1) > 1e-9:
            raise ValueError("commercial and affinity weight must sum to 1")


@dataclass(frozen=True)
class IntentParams:
    default_limit: int = 5
    pool_factor: int = 4
    max_pool: int = 50
    max_terms: int = 8
    resolved_score: float = 0.82
    resolved_gap: float = 0.12
    explicit_resolved_score: float = 0.82
    plausible_score: float = 0.4
    max_options: int = 5
