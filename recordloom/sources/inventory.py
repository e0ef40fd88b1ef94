"""The six city open-data sources.

Fixed values: dataset ids, row floors, column names and their roles. One line per column in
publication order: the name, then its roles (none means public and nothing more).
"""

from __future__ import annotations

from recordloom.sources.contracts import (
    DEFAULT_RESTRICTED_PATTERNS,
    Inventory,
    SourceContract,
)

_PORTAL = "https://data.austintexas.gov"


def _columns(listing: str) -> dict[str, tuple[str, ...]]:
    rows = [line.split() for line in listing.strip().splitlines()]
    return {row[0]: tuple(row[1:]) for row in rows}


CAMPAIGN_REPORTS = SourceContract(
    slug="campaign-reports",
    dataset_id="b2pc-2s8n",
    title="Campaign Finance - Report Detail",
    portal=_PORTAL,
    expected_minimum_rows=1_000,
    columns=_columns("""
        report_id unique
        filer_name identity
        form_type category
        report_type category
        report_type2
        link_to_report
        date_filed date
        date_due date
        period_from date
        period_to date
        election_date date
        election_type
        office_held
        office_sought
        unitemized_contrib_total amount
        contrib_total amount
        unitemized_expend_total amount
        expend_total amount
        contrib_balance amount
        outstand_loan amount
        unitemized_inkind_total amount
        unitemized_pledge_total amount
        unitemized_loan_total amount
        unitemized_unpaid_total amount
        unitemized_cred_card_total amount
        filer_address_2 restricted
        filer_city restricted
        treasurer_name restricted
        treasurer_address_2 restricted
        treasurer_city_state_zip restricted
        filer_phone restricted
        treasurer_state restricted
        treasurer_zip_code restricted
        treasurer_phone restricted
    """),
)

CAMPAIGN_TRANSACTIONS = SourceContract(
    slug="campaign-transactions",
    dataset_id="g4yx-aw9r",
    title="Campaign Finance - Transaction Detail",
    portal=_PORTAL,
    expected_minimum_rows=100_000,
    candidate_amount="transaction_amount",
    columns=_columns("""
        transaction_id unique
        report_id
        filer_name identity
        transactor_name identity
        entity category
        transaction_type category
        transaction_amount amount
        date_filed date
        form
        transaction
        date_due date
        report_type
        election_date date
        election_type
        office_held
        office_sought
        link_to_report
        cor_flag
        schedule_reported
        transaction_date date
        transaction_description
        expense_description
        lender_institution
        interest_rate
        maturity_date date
        collateral
        personal_funds_deposited
        amount_guaranteed amount
        outside_travel
        political_obligation
        reimbursement_intended
        returned_to_filer
        out_of_state_pac
        out_of_state_pac_id
        transactor_address_2 restricted
        transactor_city restricted
        transactor_state restricted
        transactor_zip_code restricted
        transactor_employer restricted
        transactor_occupation restricted
        guarantor_name restricted
        guarantor_address_2 restricted
        guarantor_city restricted
        guarantor_employer restricted
        guarantor_occupation restricted
    """),
)

CAMPAIGN_CONTRIBUTIONS = SourceContract(
    slug="campaign-contributions",
    dataset_id="3kfv-biw6",
    title="Campaign Finance - Contributions",
    role="official_projection",
    portal=_PORTAL,
    expected_minimum_rows=100_000,
    name_field="donor",
    type_field="donor_type",
    type_values=("ENTITY",),
    candidate_amount="contribution_amount",
    columns=_columns("""
        transaction_id unique
        donor identity
        donor_type category
        recipient identity
        contribution_date date
        contribution_amount amount
        contribution_year
        contribution_type category
        date_reported
        report_filed
        in_kind_description
        out_of_state_pac
        correction category
        view_report
        donor_address restricted
        city_state_zip restricted
        donor_reported_occupation restricted
        donor_reported_employer restricted
    """),
)

ECHECKBOOK = SourceContract(
    slug="echeckbook",
    dataset_id="8c6z-qnmj",
    title="Austin Finance Online eCheckbook",
    portal=_PORTAL,
    expected_minimum_rows=2_000_000,
    name_field="lgl_nm",
    code_field="vend_cust_cd",
    code_prefixes=("MIS",),
    candidate_amount="amount",
    columns=_columns("""
        fy_dc
        per_cd
        dept_cd
        dept_nm
        fund_cd
        fund_nm
        div_cd
        div_nm
        gp_cd
        gp_nm
        ocat_cd
        ocat_nm
        obj_cd
        obj_nm
        lgl_nm identity
        vend_cust_cd identity
        vend_cust_ind category
        rfed_doc_cd
        rfed_doc_dept_cd
        rfed_doc_id
        comm_cd
        comm_dscr
        chk_eft_iss_dt date
        cvl_chk_sta_dv category
        rfed_vend_ln_no
        rfed_comm_ln_no
        rfed_actg_ln_no
        rf_doc_cd
        rf_doc_dept_cd
        rf_doc_id
        actg_ln_dscr
        amount amount
        cal_year
        cal_month
    """),
)

CONTRACTS = SourceContract(
    slug="contracts",
    dataset_id="84ih-p28j",
    title="City of Austin Contracts",
    role="current_only",
    portal=_PORTAL,
    expected_minimum_rows=500,
    name_field="lgl_nm",
    code_field="vend_cust_cd",
    code_prefixes=("MIS",),
    columns=_columns("""
        doc_cd
        doc_dept_cd
        doc_id
        doc_vers_no
        doc_dscr
        contract_synopsis
        ma_prch_lmt_am amount
        ma_itd_ord_am amount
        ma_do_rfed_am amount
        efbgn_dt date
        efend_dt date
        gnrc_po_rpt_1
        rpt_dscr
        brd_awd_dt date
        brd_awd_no
        cat_dscr
        doc_vend_ln_no
        vend_cust_cd identity
        lgl_nm identity
        alias_nm identity
        so_doc_cd
        so_doc_dept_cd
        so_doc_id
        today date
        row_key unique
        contract_contact_nm restricted
        contract_contact_voice_ph_no restricted
        contract_contact_email_ad restricted
    """),
)

PURCHASE_ORDERS = SourceContract(
    slug="purchase-orders",
    dataset_id="3ebq-e9iz",
    title="Purchase Order Quantity and Price",
    portal=_PORTAL,
    expected_minimum_rows=300_000,
    name_field="lgl_nm",
    code_field="vendor_code",
    code_prefixes=("MIS",),
    candidate_amount="itm_tot_am",
    restricted_patterns=(*DEFAULT_RESTRICTED_PATTERNS, "ad_ln"),
    columns=_columns("""
        commodity
        commodity_description
        extended_description
        quantity
        unit_of_measure
        unit_of_meas_desc
        unit_price amount
        itm_tot_am amount
        master_agreement
        contract_name
        purchase_order
        award_date date
        vendor_code identity
        lgl_nm identity
        data_build_date date
        ad_ln_1 restricted
        ad_ln_2 restricted
        city restricted
        st restricted
        zip restricted
        ctry restricted
    """),
)

INVENTORY = Inventory(
    [CAMPAIGN_REPORTS, CAMPAIGN_TRANSACTIONS, CAMPAIGN_CONTRIBUTIONS, ECHECKBOOK, CONTRACTS, PURCHASE_ORDERS]
)
# Which side of the match each source is on.
CAMPAIGN_SOURCE = "campaign-contributions"
PUBLIC_SOURCES = ("echeckbook", "contracts", "purchase-orders")
